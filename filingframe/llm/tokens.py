"""Token counts of articles; huge texts are encoded in overlapping chunks that are spliced."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema, read_articles, small_batches, utf8

# Places that no token of a vocabulary reaches over. Before white space in all of them; where the
# file cuts texts by its own pattern also between letters, digits and other characters, but not
# behind an apostrophe, which may stand in front of the ending of a word.
_SPACED = regex.compile(r"\P{White_Space}(?=\p{White_Space})")
_CLASSES = regex.compile(
    r"\P{White_Space}(?=\p{White_Space})|\p{L}(?=[^\p{L}\p{White_Space}])|\p{N}(?=[^\p{N}\p{White_Space}])|[^\p{L}\p{N}\p{White_Space}'](?=[\p{L}\p{N}])"
)
Encode = Callable[[str], tuple[np.ndarray, np.ndarray]]


class Counter:
    """A public tokenizer: ``.json`` by tokenizers, ``.model`` by sentencepiece; nothing added, nothing cut."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.json = path.endswith(".json")
        if self.json:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            before = spec.get("pre_tokenizer") or {}
            self.classes = before.get("type") == "ByteLevel" and before.get("use_regex", True)
            self.special = [t["content"] for t in spec.get("added_tokens") or []]
        else:
            from sentencepiece import SentencePieceProcessor

            self.tokenizer = SentencePieceProcessor(model_file=path)
            self.classes = False

    def turns(self, text: str) -> regex.Pattern:
        """Turns of a text; special strings, which have letters next to other characters, are not to be parted."""
        return _CLASSES if self.classes and not any(s in text for s in self.special) else _SPACED

    def count(self, texts: list[str]) -> list[int]:
        if self.json:
            return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(ids) for ids in self.tokenizer.encode(texts, num_threads=1)]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 character of each token."""
        if self.json:
            both = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        else:  # places in UTF-8
            spans = [(p.begin, p.end) for p in self.tokenizer.encode(text, return_type="proto").pieces]
            characters = np.cumsum(np.r_[0, (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80])
            both = characters[np.array(spans, np.int64).reshape(-1, 2)]
        return both[:, 0], both[:, 1]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _boundary(text: str, low: int, high: int, left: tuple, right: tuple, turns: regex.Pattern) -> int | None:
    """Last turn in [low, high] where both encodings have a token boundary."""
    for m in reversed(list(turns.finditer(text, low, high))):
        at = m.end()
        if all(not np.any((starts < at) & (ends > at)) for starts, ends in (left, right)):
            return at
    return None


def _end(text: str, start: int, chunk: int, overlap: int, turns: regex.Pattern) -> int:
    """Where a piece ends: ``chunk`` characters on, or so far that the overlap with the next holds a turn."""
    end = start + chunk
    turn = turns.search(text, max(start, end - overlap) + 1) if end < len(text) else None
    return min(len(text), max(end, turn.end() + overlap // 2)) if turn else len(text)


def count_in_chunks(text: str, spans: Encode, chunk: int, overlap: int, turns: regex.Pattern = _SPACED) -> int:
    """Tokens of ``text`` from encodings of pieces of about ``chunk`` characters.

    Two neighbouring pieces share ``overlap`` characters. They are spliced at a turn in the
    shared part: a new token always begins there, so what stands left of it does not depend on the
    right and the other way round, and both encodings must show the boundary. If they do not, the
    overlap is doubled, and when it would reach back to the last splice, the piece itself doubles.
    A piece ends behind a turn, so a stretch without any, however long, is one piece, encoded once.
    """
    total, done, end = 0, 0, _end(text, 0, chunk, overlap, turns)
    left = spans(text[:end])
    while end < len(text):
        stop = _end(text, end, chunk, overlap, turns)
        shared, spliced = overlap, None
        while spliced is None:
            begin = max(done, end - shared)
            shared *= 2
            if begin == done:
                break
            if turns.search(text, begin + 1, end):
                starts, ends = spans(text[begin:stop])
                right = (starts + begin, ends + begin)
                # the first word of a piece may be cut: only boundaries behind its end count
                spliced = _boundary(text, begin + 1, end, left, right, turns)
        if spliced is None:  # no boundary since the last splice: one piece of twice the size from there
            end = max(stop, min(len(text), 2 * end - done))
            starts, ends = spans(text[done:end])
            left = (starts + done, ends + done)
            continue
        total += int(np.count_nonzero((left[0] >= done) & (left[0] < spliced)))
        done, left, end = spliced, right, stop
    return total + int(np.count_nonzero(left[0] >= done))


def count_tokens(
    articles: DataFrame, tokenizer: str, *, url: str = "url", content: str = "content", chunk: int = 1 << 15, overlap: int = 512
) -> DataFrame:
    """(url, n_bytes, n_tokens): UTF-8 bytes and tokens of each whole article under a public tokenizer.

    ``tokenizer`` is the path of its file, the same on all machines. Texts of up to ``chunk``
    characters are encoded whole, longer ones piece by piece, so a task holds one text and the
    encoding of one piece. One row per input row, repeated rows and urls too, no shuffle; columns
    beyond the two named are left behind. Null and empty texts have no tokens; an empty table gives
    no rows; special strings inside a text are handled as the tokenizer file says.
    """
    rows = read_articles(articles, url, content)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in small_batches(batches, "content", 1 << 19):
            raw = utf8(batch.column("content"))
            texts = [t.decode() for t in raw]
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            counts = dict(zip(short, own.count([texts[i] for i in short]), strict=True))
            n = [counts[i] if i in counts else count_in_chunks(t, own.spans, chunk, overlap, own.turns(t)) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array([len(t) for t in raw], pa.int64()), pa.array(n, pa.int64())], names=["url", "n_bytes", "n_tokens"])

    return rows.mapInArrow(measure, arrow_schema(rows, ["url"], ("n_bytes", T.LongType()), ("n_tokens", T.LongType())))
