"""Sentence pieces of articles with the bytes of the text each piece stands for."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema, read_articles, small_batches, utf8

SPACE = "▁"  # stands for a space inside pieces
_MARK = SPACE.encode()
_PART = 1 << 15  # characters the library gets at once, where the text can be cut
_UNKNOWN, _CONTROL, _USER, _BYTE = 2, 3, 4, 6  # piece types of the model file


class CharacterMap:
    """The compiled character map of a model: a double-array trie and the replacements behind it.

    The file holds the length of the trie in bytes, its 32-bit units, then the replacements, each
    ended by a zero byte. A unit carries the label it is reached by, whether a key ends there, and
    the offset of its children; the leaf behind such a unit holds the place of the replacement.
    """

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.replacements = compiled[4 + size :]
        self.known: dict[bytes, tuple[bytes, int] | None] = {}

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes read) of the longest key that ``text`` has at ``at``."""
        units, found, read = self.units, None, 0
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for byte in text[at : at + 64]:
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            read += 1
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                start = units[node] & 0x7FFFFFFF
                found = self.replacements[start : self.replacements.index(0, start)], read
        return found


def _width(byte: int) -> int:
    """Bytes of the UTF-8 character that begins with ``byte``."""
    return 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


class PieceEncoder:
    """Ids and byte spans as the library gives them.

    A text is normalised first: the longest key of the character map is replaced, and every byte
    of the normal form keeps its place in the original. ``bare``, the same model without any
    normalisation, encodes the normal form; the lengths of the pieces give their place in it, and
    so the bytes of the text. A long normal form is cut where the vocabulary has no piece with the
    two characters that meet: no merge reaches over such a place.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(raw)
        self.whole = SentencePieceProcessor(model_proto=raw)
        form = spec.normalizer_spec
        self.map = CharacterMap(form.precompiled_charsmap) if form.precompiled_charsmap else None
        self.escape = _MARK if form.escape_whitespaces else b" "
        self.prefix = form.add_dummy_prefix and not spec.trainer_spec.treat_whitespace_as_suffix
        self.suffix = form.add_dummy_prefix and spec.trainer_spec.treat_whitespace_as_suffix
        self.squeeze = form.remove_extra_whitespaces
        self.user = sorted((p.piece.encode() for p in spec.pieces if p.type == _USER), key=len, reverse=True)
        texts = [p.piece for p in spec.pieces if p.type not in (_UNKNOWN, _CONTROL, _BYTE)]
        pairs = {a + b for t in texts for a, b in zip(t, t[1:], strict=False)}
        bpe = spec.trainer_spec.model_type == spec.trainer_spec.BPE
        self.mergeable = bpe and bool(pairs)
        self.unknown = spec.trainer_spec.unk_id
        self.sizes = np.array([len(p.piece.encode()) for p in spec.pieces], np.int64)
        self.bytes = np.array([int(p.piece[3:5], 16) if p.type == _BYTE else -1 for p in spec.pieces], np.int64)
        self.pairs = np.array(sorted((ord(a) << 21) | ord(b) for a, b in pairs), np.int64)
        form.precompiled_charsmap, form.add_dummy_prefix, form.remove_extra_whitespaces, form.escape_whitespaces = b"", False, False, False
        self.bare = SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.ends = (spec.trainer_spec.bos_id, spec.trainer_spec.eos_id)

    # -- normal form ---------------------------------------------------------------------------
    def _prefix_at(self, text: bytes, at: int) -> tuple[bytes, int]:
        """What the characters at ``at`` become, and how many bytes they are."""
        for symbol in self.user:
            if text.startswith(symbol, at):
                return symbol, len(symbol)
        found = self.map.longest(text, at) if self.map else None
        if found:
            return found
        width = _width(text[at])
        return text[at : at + width], width

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normal form, and for each of its bytes, and its end, the byte of ``text`` it comes from."""
        if not self.map and not self.user and not self.squeeze:
            return self._escaped(text)
        out, source, at, size = bytearray(), [], 0, len(text)
        while self.squeeze and at < size:
            form, read = self._prefix_at(text, at)
            if form != b" ":
                break
            at += read
        if at == size:
            return b"", np.array([at], np.int64)

        def put(form: bytes) -> None:
            out.extend(form)
            source.extend([at] * len(form))

        if self.prefix:
            put(self.escape)
        spaced = self.squeeze
        while at < size:
            form, read = self._prefix_at(text, at)
            if spaced:
                form = form.lstrip(b" ")
            if form:
                put(form.replace(b" ", self.escape))
                spaced = self.squeeze and form.endswith(b" ")
            at += read
        while self.squeeze and out.endswith(self.escape):
            at = source[len(out) - len(self.escape)]
            del out[-len(self.escape) :], source[-len(self.escape) :]
        if self.suffix:
            put(self.escape)
        return bytes(out), np.array([*source, at], np.int64)

    def _escaped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normal form of a model that only writes spaces as marks."""
        if not text:
            return b"", np.zeros(1, np.int64)
        mark = len(self.escape)
        widths = np.where(np.frombuffer(text, np.uint8) == 32, mark, 1)
        before, behind = mark * self.prefix, mark * self.suffix
        source = np.r_[np.zeros(before, np.int64), np.repeat(np.arange(len(text)), widths), np.full(behind + 1, len(text))]
        return self.escape * self.prefix + text.replace(b" ", self.escape) + self.escape * self.suffix, source

    # -- pieces --------------------------------------------------------------------------------
    def _parts(self, text: str) -> list[str]:
        """A long normal form in parts of about ``_PART`` characters, cut where no piece holds the two that meet."""
        if len(text) <= _PART or not self.mergeable:
            return [text]
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        joined = (codes[:-1] << 21) | codes[1:]
        places = np.minimum(np.searchsorted(self.pairs, joined), len(self.pairs) - 1)
        free = np.flatnonzero(self.pairs[places] != joined) + 1
        cuts = [0]
        while (i := np.searchsorted(free, cuts[-1] + _PART)) < len(free):
            cuts.append(int(free[i]))
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]

    def _widths(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the normal form each piece stands for; of a character in byte pieces the last has all."""
        widths = self.sizes[ids]
        value = self.bytes[ids]
        spelled = value >= 0
        if spelled.any():
            inner = (value & 0xC0) == 0x80
            inner &= spelled
            lead = np.maximum.accumulate(np.where(spelled & ~inner, np.arange(len(ids)), 0))
            last = spelled & ~np.r_[inner[1:], False]
            widths = np.where(spelled, np.where(last, np.arange(len(ids)) - lead + 1, 0), widths)
        return widths

    def _spans(self, parts: list[str], ids: list[list[int]], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and their first bytes and last bytes + 1 in the united parts."""
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(counts.sum()))
        widths = self._widths(flat)
        stops = np.r_[0, np.cumsum(counts)]
        for i in np.unique(np.searchsorted(stops, np.flatnonzero(flat == self.unknown), side="right") - 1):
            pieces = self.bare.encode_as_proto(parts[i]).pieces  # an unknown piece has no length of its own
            widths[stops[i] : stops[i + 1]] = [p.end - p.begin for p in pieces]
        ends = np.cumsum(widths)
        return flat, ends - widths, ends

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, first bytes and last bytes + 1 of every text, without begin and end."""
        forms = [self.normalise(t) for t in texts]
        parts = [self._parts(form.decode()) for form, _ in forms]
        flat = [p for of_text in parts for p in of_text]
        ids = self.bare.encode(flat, num_threads=1) if flat else []
        counts = np.array([len(x) for x in ids], np.int64)
        coded, begins, ends = self._spans(flat, ids, counts)
        stop = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)]
        out, base = [], 0
        for i, (form, source) in enumerate(forms):
            a, b = stop[i], stop[i + 1]
            out.append((coded[a:b], source[begins[a:b] - base], source[ends[a:b] - base]))
            base += len(form)
        return out


@lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_articles(articles: DataFrame, model: str, *, url: str = "url", content: str = "content") -> DataFrame:
    """(url, n_tokens, ids, begins, ends, decoded): sentence pieces of each whole article and the text they give back.

    ``model`` is the path of a sentence-piece model, the same on all machines. ``ids`` has begin and
    end around the pieces; ``begins`` and ``ends`` name the bytes of the article each id stands for
    (begin and end stand for none; of a character spelled in bytes the last has the bytes, the ones
    before it none). All three are little-endian unsigned 32-bit integers. ``decoded`` is what the
    library makes of the ids.

    One row per input row, repeated rows and urls too, without a shuffle; columns beyond the two
    named are left behind. Null and empty contents have begin and end only and decode to an empty
    text; an empty table gives no rows. A long article is encoded in parts of some ten thousand
    characters, so a task holds its ids and their places, but the library's working memory only of
    a part; a run of characters that the vocabulary joins throughout (one letter repeated) is a
    part by itself, however long.
    """
    rows = read_articles(articles, url, content)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(model)
        first, last = (np.array([i], "<u4") for i in own.ends)
        for batch in small_batches(batches, "content"):
            texts = utf8(batch.column("content"))
            spans = own.encode(texts)
            coded = [np.r_[first, ids, last] for ids, _, _ in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("url"), pa.array([len(x) for x in coded], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in coded], pa.binary()),
                    *(
                        pa.array([np.r_[0, x[j], len(t)].astype("<u4").tobytes() for x, t in zip(spans, texts, strict=True)], pa.binary())
                        for j in (1, 2)
                    ),
                    pa.array([own.whole.decode(x.tolist()) for x in coded], pa.string()),
                ],
                names=["url", "n_tokens", "ids", "begins", "ends", "decoded"],
            )

    fields = [("n_tokens", T.LongType()), *((n, T.BinaryType()) for n in ("ids", "begins", "ends")), ("decoded", T.StringType())]
    return rows.mapInArrow(encode, arrow_schema(rows, ["url"], *fields))
