"""Token counts with overlap resynchronisation for huge documents.

A document up to CHUNK characters is encoded whole. A longer one is cut in overlapping chunks, each from an arbitrary
place on. The tokenizer first splits a text, left to right, into pre-tokens, without looking back; so once two chunks share
the start of a pre-token, all that follows is equal, and the left chunk's starts are those of the whole text up to a margin
before its right edge (the splitter looks at most at a special string's length ahead, white space runs end at the edge).
The chunks are spliced at the first start that both have, and what lies before it is encoded, once. Where an overlap has
none, it is widened to the left chunk's last sure start; where that is the chunk's own first, one pre-token is longer than
the chunk, and the chunk is doubled. Work is so in proportion to the text, with and without white space.
"""

from __future__ import annotations

import re
from json import loads as json_of

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, table
from .wordcoder import tokenizer_json

CHUNK = 32_768
OVERLAP = 512
LIMIT = 1024
LONG = 256  # characters of a word that is split as the tokenizer does, and isn't kept in the memo

_ODD = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(r"(\s+)")


class Counter:
    """Counts tokens exactly as the tokenizers library does, with a memo over pre-token runs."""

    def __init__(self, json: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        # units rest on a byte-level splitter, no normalizer, and special strings that are found as they stand
        shape = json_of(json)
        self.chunked = shape.get("normalizer") is None and (shape.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not shape["pre_tokenizer"].get("add_prefix_space") and not any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.margin = max([4, *(len(s) + 4 for s in self.specials)])
        self.chunk, self.overlap = chunk, max(1, overlap)
        self.run = Cache(self.library_count)
        self.spaced = Cache(lambda w: self.library_count(" " + w))
        self.widened = 0

    def library_count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def plain(self, text: str) -> bool:
        return not _ODD.search(text) and not any(s in text for s in self.specials)

    def small(self, text: str) -> int:
        """Words between single spaces and line feeds one by one; other texts by units()."""
        if not text:
            return 0
        if self.plain(text):
            lines = [line.split(" ") for line in text.split("\n")]
            n = sum(map(len, lines))
            if n == len(text.split()) and not any("" in line for line in lines):
                run, spaced = self.run, self.spaced
                return len(lines) - 1 + sum(run[line[0]] + sum(map(spaced.__getitem__, line[1:])) for line in lines)
        return self.tokens(self.units(text)[1])

    def tokens(self, units: list) -> int:
        """Tokens of units: numbers, or texts to be encoded (short ones once for all)."""
        return sum(u if isinstance(u, int) else self.run[u] if len(u) <= LONG else self.library_count(u) for u in units)

    def units(self, text: str) -> tuple[np.ndarray, list]:
        """Where runs of whole pre-tokens start, and each as a text or, where it is known, as its number of tokens.

        A white-space run before a word gives all but its last character to one pre-token; a last space belongs to
        the word, another last character is a pre-token of its own; a run at the text's end is one pre-token. A long
        word is split as the tokenizer splits it."""
        if not self.plain(text):
            starts, units, at = [], [], 0
            for m in [*(self.special.finditer(text) if self.special else ()), None]:
                end = m.start() if m else len(text)
                for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text[at:end]) if at < end else ():
                    starts.append(at + a)
                    units.append(text[at + a : at + b])
                if m:
                    starts.append(end)
                    units.append(1)
                    at = m.end()
            return np.array(starts, dtype=np.int64), units
        parts = _SPACES.split(text)
        starts, units, at = [], [], 0

        def add(unit):
            nonlocal at
            if len(unit) > LONG:
                for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit):
                    starts.append(at + a)
                    units.append(unit[a:b])
            elif unit:
                starts.append(at)
                units.append(unit)
            at += len(unit)

        add(parts[0])
        for space, word in zip(parts[1::2], parts[2::2]):
            if not word:
                add(space)
            elif space[-1] == " ":
                add(space[:-1])
                add(" " + word)
            else:
                add(space[:-1])
                add(space[-1])
                add(word)
        return np.array(starts, dtype=np.int64), units

    def count(self, text: str) -> int:
        if not self.chunked:
            return self.library_count(text)
        if len(text) <= self.chunk:
            return self.small(text)
        total, begin, edge = 0, 0, self.chunk
        starts, units = self.units(text[:edge])
        while edge < len(text):
            sure = starts[starts <= edge - self.margin]
            overlap = self.overlap
            while True:
                if not len(sure) or sure[-1] <= begin:  # one pre-token fills the chunk
                    edge = min(len(text), begin + 2 * (edge - begin))
                    starts, units = self.units(text[begin:edge])
                    starts = starts + begin
                    break
                self.widened += int(sure[-1]) < edge - overlap
                cut = max(begin + 1, min(edge - overlap, int(sure[-1])))
                end = min(len(text), max(cut, edge) + self.chunk)
                s, u = self.units(text[cut:end])
                s = s + cut
                common = np.intersect1d(sure[sure >= cut], s)
                if len(common):
                    p = int(common[0])
                    total += self.tokens(units[: int(np.searchsorted(starts, p))])
                    k = int(np.searchsorted(s, p))
                    starts, units, begin, edge = s[k:], u[k:], p, end
                    break
                self.widened += 1
                sure = sure[: np.searchsorted(sure, cut)]
                overlap *= 2
        return total + self.tokens(units)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; null texts count as empty, with no tokens; repeated rows and
    null doc_ids are rows like others; an empty table gives no rows."""
    json = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))  # a file of fixed size

    def run(batches):
        import pyarrow as pa

        counter = _counter(json.value, chunk, overlap)
        for batch in batches:
            n = [counter.count(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", size.alias("n_bytes"), "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


_counters: dict = {}


def _counter(json: str, chunk: int, overlap: int) -> Counter:
    """One for each Python worker, so that its memo lives on from task to task."""
    key = (hash(json), chunk, overlap)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(json, chunk, overlap)
    return _counters[key]


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
