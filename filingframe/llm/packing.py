"""Training sequences from tokenised articles, by best-two-fit packing."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, read_articles, small_batches, utf8, written

# Bytes of the characters U+0020-U+007E, U+00A0-U+017F, tab and line ends. Their class, lower case and
# normal form are the same to the tokenizer and to Python, but for those of _OTHER.
_PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC2, 0xC6)])
_OTHER = re.compile(b"\xc2[\x80-\xa0]|\xc4\xb0")
_CACHE = 1_400_000  # words a task remembers


class Encoder:
    """Token ids as little-endian unsigned 32-bit integers, ``end`` behind each text.

    No token of a word tokenizer reaches over white space, so what stands between white space is
    encoded by itself, and need not be encoded again when it comes back. Texts with other than
    Latin characters, or with what could be a special string, are encoded whole by the library.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = np.uint32(end).tobytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        cut = next((p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.words = regex.compile(cut["pattern"]["Regex"]) if suffix and cut and cut["invert"] and kinds == ["NFC", "Replace", "Lowercase"] else None
        self.special = [t["content"].lower().encode() for t in spec["added_tokens"]]
        self.cache: dict[str, bytes] = {}
        if self.words:
            vocabulary = spec["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _cut(self, part: str) -> list[str]:
        """Words of a part: letters, digits and runs of other characters apart, as the tokenizer cuts."""
        if part.isalpha():
            return [part]
        if part[:-1].isalpha() and part[-1] in ".,!?;:":
            return [part[:-1], part[-1]]
        return self.words.findall(part)

    def _learn(self, parts: list[str]) -> bool:
        """Encodes the new words of new parts in one call and cuts the ids behind each word."""
        cut = [self._cut(p) for p in parts]
        new = list({w for words in cut for w in words}.difference(self.cache))
        ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.last[np.minimum(ids, len(self.last) - 1)]) + 1
        if len(ends) != len(new) or ends[-1:].sum() != len(ids):
            return False
        raw, at = ids.tobytes(), 0
        for word, end in zip(new, (4 * ends).tolist(), strict=True):
            self.cache[word] = raw[at:end]
            at = end
        get = self.cache.__getitem__
        self.cache.update((p, b"".join(map(get, words))) for p, words in zip(parts, cut, strict=True) if len(words) != 1)
        return True

    def _by_parts(self, texts: list[bytes]) -> list[bytes] | None:
        """Every different part is looked up once; its ids are then laid out at all its places."""
        parts = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.binary()).cast(pa.string())))
        coded = parts.values.dictionary_encode()
        met = coded.dictionary.to_pylist()
        if len(self.cache) > _CACHE:
            self.cache = {w: self.cache[w] for w in met if w in self.cache}
        known = list(map(self.cache.get, met))
        gaps = [i for i, ids in enumerate(known) if ids is None]
        new = [met[i] for i in gaps]
        if not all(self._learn(new[i : i + 4096]) for i in range(0, len(new), 4096)):
            return None
        for i in gaps:
            known[i] = self.cache[met[i]]
        table = np.frombuffer(b"".join(known), np.uint32)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, code = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        n = sizes[code]
        ends = np.r_[0, np.cumsum(n)]
        ids = table[np.repeat(starts[code] - ends[:-1], n) + np.arange(ends[-1])]
        at = ends[parts.offsets.to_numpy()]
        return [ids[a:b].tobytes() + self.end for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        if self.words:
            plain = [i for i, t in enumerate(texts) if not t.translate(None, _PLAIN) and not _OTHER.search(t) and not any(s in t.lower() for s in self.special)]
            for i, ids in zip(plain, self._by_parts([texts[i] for i in plain]) or [], strict=False):
                out[i] = ids
        return [o if o is not None else self.whole(t.decode()) + self.end for o, t in zip(out, texts, strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


def encode_pieces(
    articles: DataFrame, tokenizer: str, *, url: str = "url", content: str = "content", capacity: int = 4096, end: int = 1
) -> DataFrame:
    """(url, piece, start, length, ids): token ids of each article, cut only where longer than ``capacity``.

    ``ids`` are little-endian unsigned 32-bit integers; ``end`` is appended to every article, so a
    null or empty text is that one token. Pieces count from 0, all but the last are full. Every input
    row gives its pieces, repeated rows and urls too; columns beyond the two named are left behind;
    an empty table gives no rows.
    """
    rows = read_articles(articles, url, content)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, end)
        for batch in small_batches(batches, "content", 4 << 20):
            ids = own.encode(utf8(batch.column("content")))
            parts = [(i, at // (4 * capacity), x[at : at + 4 * capacity]) for i, x in enumerate(ids) for at in range(0, len(x), 4 * capacity)]
            piece = np.array([p for _, p, _ in parts], np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("url").take(pa.array([i for i, _, _ in parts], pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity),
                    pa.array([len(x) // 4 for _, _, x in parts], pa.int64()), pa.array([x for _, _, x in parts], pa.binary()),
                ],
                names=["url", "piece", "start", "length", "ids"],
            )

    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType())]
    return rows.mapInArrow(encode, arrow_schema(rows, ["url"], *fields))


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length.

    A bin is opened with the longest piece left and filled with the longest that still fits. Then
    its smallest piece is exchanged for the two unpacked ones that fill the widened gap best, as
    long as that leaves a smaller gap. Pieces of one length are used in the order given.
    """
    order = np.argsort(lengths, kind="stable")
    left = np.bincount(lengths, minlength=capacity + 1)
    first = np.cumsum(left) - left
    have = sum(1 << int(n) for n in np.flatnonzero(left))
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> None:
        nonlocal have
        left[n] -= 1
        if not left[n]:
            have ^= 1 << n

    bins: list[list[int]] = []
    while have:
        items = [have.bit_length() - 1]
        take(items[0])
        gap = capacity - items[0]
        while gap and (n := (have & ((2 << gap) - 1)).bit_length() - 1) > 0:
            items.append(n)
            take(n)
            gap -= n
        while gap and have:
            wide = gap + items[-1]
            sizes = np.flatnonzero(left[: wide + 1])
            sizes = sizes[sizes > 0]
            partner = sizes[np.maximum(np.searchsorted(sizes, wide - sizes, side="right") - 1, 0)] if len(sizes) else sizes
            sums = np.where((sizes + partner <= wide) & ((sizes != partner) | (left[sizes] > 1)), sizes + partner, 0)
            if not len(sums) or sums.max() <= items[-1]:
                break
            best = int(sums.argmax())
            small = items.pop()
            have |= 1 << small
            left[small] += 1
            pair = sorted((int(sizes[best]), int(partner[best])), reverse=True)
            for n in pair:
                take(n)
            items = sorted([*items, *pair], reverse=True)
            gap = capacity - sum(items)
        bins.append(items)
    for b, items in enumerate(bins):
        at = 0
        for n in items:
            row = order[first[n]]
            first[n] += 1
            number[row], offset[row] = b, at
            at += n
    return number, offset


def pack_pieces(pieces: DataFrame, *, length: str = "length", capacity: int = 4096, group_sequences: int = 1024) -> DataFrame:
    """All columns of ``pieces`` with ``sequence`` (any number) and ``offset`` (its place there, without gaps).

    Pieces are dealt by a hash of their row number into groups that fill about ``group_sequences``
    sequences, whatever the length of a piece; each group fills sequences of its own, of which at
    most a few stay partly empty, so the loss is about one sequence in a thousand and no task sees
    more than one group. Give it narrow rows: the ids need not come along. Repeated rows are packed
    each; columns of the names ``sequence``, ``offset``, ``_row`` and ``_group`` are replaced. An empty
    table gives no rows; lengths must lie between 1 and ``capacity``.
    """
    pieces = pieces.drop("sequence", "offset", "_row", "_group")
    rows = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    tokens = rows.agg(F.sum(length)).first()[0] or 0
    groups = max(1, tokens // (capacity * group_sequences))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        number, offset = best_two_fit(table[length].to_numpy(), capacity)
        group = table["_group"].to_numpy()
        return table.drop_columns(["_row", "_group"]).append_column("sequence", pa.array((group << 32) + number)).append_column("offset", pa.array(offset))

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).groupBy("_group").applyInArrow(pack, schema)
