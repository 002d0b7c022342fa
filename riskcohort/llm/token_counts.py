"""Token counts of documents, with every distinct pre-token counted once.

The pre-tokens are the runs of bytes other than ASCII white space: the tokenizers supported never join
pieces across white space (which they drop), so a text has as many tokens as its pre-tokens have.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from riskcohort.llm.common import SPACE, batch, id_and_text

# Frequent pre-tokens are counted by a broadcast join: at most so many, and no longer than this. They are picked from
# one text in SHOWN; the pick moves work between the two ways of counting and changes no result.
FREQUENT = 1 << 18
FREQUENT_BYTES = 64
SHOWN = 16
# Pre-tokens whose ids a task keeps at most.
PARTS = 250_000

@cache
def tokenizer(path: str):
    """The tokenizer of a .json file, without truncation or padding; loaded once per process."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def word_tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The normalizer and pre-tokenizer for which ``WordEncoder`` can split words itself.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# Characters that NFC leaves alone, that are lower-cased one by one alike everywhere, and of settled classes.
_PLAIN = regex.compile("[\n\x21-\x7E\u00A1-\u012F\u0131-\u017F]*")


def _byte_characters() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for those from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in kept)}


@cache
def _splits(path: str) -> bool:
    """Whether ``WordEncoder`` can split words itself; the file is parsed once per process."""
    form = json.loads(tokenizer(path).to_str())
    return form["normalizer"] == _NORMALIZER and form["pre_tokenizer"] == _PRE_TOKENIZER and all(
        t["content"].startswith("<|") for t in form["added_tokens"])


class WordEncoder:
    """Token ids of words without white space.

    Plain words are cut into pre-tokens here and only new pre-tokens go through the model; all others, and words
    that may hold special tokens, go through the whole tokenizer, as do all words of a tokenizer of another kind.
    """

    def __init__(self, path: str) -> None:
        self.whole, self.split = tokenizer(path), _splits(path)
        self.cut, self.table = regex.compile(_PATTERN), _byte_characters()
        self.parts: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[list[int]]:
        if self.split and words:
            joined = "\n".join(words)
            if "<|" not in joined and _PLAIN.fullmatch(joined):
                return self._plain(joined)
            plain = [w for w in words if "<|" not in w and "\n" not in w and _PLAIN.fullmatch(w)]
            found = dict(zip(plain, self._plain("\n".join(plain)))) if plain else {}
            rest = [w for w in words if w not in found]
            found.update(zip(rest, self._library(rest)))
            return [found[w] for w in words]
        return self._library(words)

    def _library(self, words: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(words), 20_000)
                for e in self.whole.encode_batch_fast(words[i:i + 20_000], add_special_tokens=False)]

    def _plain(self, joined: str) -> list[list[int]]:
        words = joined.lower().split("\n")
        # Letters alone are one pre-token.
        cut = {w: self.cut.findall(w) for w in words if not w.isalpha()}
        parts = list(set().union((w for w in words if w not in cut), *cut.values()))
        mapped = [p if p.isascii() else p.encode().decode("latin-1").translate(self.table) for p in parts]
        known = {p: [t.id for t in found] for p, found in zip(parts, map(self.whole.model.tokenize, mapped))}
        return [known[w] if w not in cut else known[cut[w][0]] + known[cut[w][1]] if len(cut[w]) == 2
                else [i for p in cut[w] for i in known[p]] for w in words]


    def packed(self, words: list[str]) -> list[bytes]:
        """As :meth:`ids`, each as little-endian unsigned 32 bits. Pre-tokens of plain words are kept for the next call."""
        plain = words
        if not self.split or "<|" in (joined := "\n".join(words)) or not _PLAIN.fullmatch(joined):
            plain = [w for w in words if "<|" not in w and "\n" not in w and _PLAIN.fullmatch(w)] if self.split else []
        if len(plain) == len(words):
            return self._plain_packed(plain)
        found = dict(zip(plain, self._plain_packed(plain)))
        rest = [w for w in words if w not in found]
        found.update(zip(rest, _laid(self._library(rest))))
        return [found[w] for w in words]

    def _plain_packed(self, words: list[str]) -> list[bytes]:
        lower = "\n".join(words).lower().split("\n") if words else []
        cut = {w: self.cut.findall(w) for w in lower if not w.isalpha()}
        if len(self.parts) > PARTS:
            self.parts.clear()
        known, tokenize = self.parts, self.whole.model.tokenize
        for w in lower:
            for p in cut[w] if w in cut else (w,):
                if p not in known:
                    mapped = p if p.isascii() else p.encode().decode("latin-1").translate(self.table)
                    known[p] = pack(f"<{len(found := tokenize(mapped))}I", *[t.id for t in found])
        return [known[w] if w not in cut else b"".join([known[p] for p in cut[w]]) for w in lower]


def _laid(ids: list[list[int]]) -> list[bytes]:
    return [np.array(x, "<u4").tobytes() for x in ids]


def _counter(path: str):
    """Numbers of tokens of a list of pre-tokens."""
    encoder = WordEncoder(path)
    return lambda words: [len(ids) for i in range(0, len(words), 20_000) for ids in encoder.ids(words[i:i + 20_000])]


def frequent_pieces(rows: DataFrame, path: str, most: int) -> DataFrame:
    """``word, often``: number of tokens of at most ``most`` frequent pre-tokens."""
    schema = pa.schema([("word", pa.string()), ("often", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for b in batches:
            yield batch(schema, word=b.column("word"), often=count(b.column("word").to_pylist()))

    words = (rows.filter(F.pmod(F.xxhash64("text"), F.lit(SHOWN)) == 0)
             .select(F.explode(F.split("text", SPACE)).alias("word"))
             .filter((F.col("word") != "") & (F.octet_length("word") <= FREQUENT_BYTES)))
    return (words.groupBy("word").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "word").limit(most)
            .select("word").mapInArrow(run, "word string, often long"))


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every text, one row per input row.

    ``tokenizer_path`` names a tokenizer file whose pre-tokenizer drops white space; no begin or end tokens
    are added, special strings inside texts count as the library's default has them. A null text is empty:
    0 bytes, 0 tokens. Repeated rows and null ids are kept. An empty table gives an empty result.

    Frequent pre-tokens meet their counts in a broadcast of at most ``frequent`` words of a bounded length, and are
    summed at once. The others are dealt out by word as frequencies per document; all of a word meet in one task,
    which counts its pieces once and hands on sums per document. Ids are never kept.
    """
    rows = id_and_text(docs, id_col, text_col)
    often = F.broadcast(frequent_pieces(rows, tokenizer_path, frequent))
    # Keyed by row, so that rows with equal ids stay apart. Text is dropped before anything is shuffled.
    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    seen = (keyed.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                         F.posexplode(F.split("text", SPACE)).alias("at", "word"))
            .join(often, "word", "left"))
    # The first word's row carries what belongs to the document. A space is in no pre-token: rows that are done get
    # a key of their own instead of meeting in one.
    rest = (F.col("word") != "") & F.col("often").isNull()
    word = F.when(rest, F.col("word")).otherwise(F.concat(F.lit(" "), F.col("row").cast("string")))
    first = lambda c: F.max(F.when(F.col("at") == 0, F.col(c))).alias(c)
    frequencies = (seen.withColumn("word", word).groupBy("row", "word")
                   .agg(F.count(F.when(rest, 1)).alias("n"), F.sum(F.coalesce("often", F.lit(0))).alias("n_tokens"),
                        first("doc_id"), first("n_bytes")))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last, last_pieces = _counter(tokenizer_path), None, 0
        for b in batches:
            coded = b.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            new = [w for w in words if w[0] != " " and w != last]
            pieces = dict(zip(new, count(new)))
            if last is not None:
                pieces.setdefault(last, last_pieces)
            each = np.array([pieces.get(w, 0) for w in words], np.int64)
            if words and words[-1] in pieces:  # the word may go on in the next batch
                last, last_pieces = words[-1], pieces[words[-1]]
            tokens = b.column("n_tokens").to_numpy() + b.column("n").to_numpy() * each[coded.indices.to_numpy()]
            yield batch(schema, row=b.column("row"), doc_id=b.column("doc_id"), n_bytes=b.column("n_bytes"), n_tokens=tokens)

    counted = (frequencies.select("row", "word", "n", "n_tokens", "doc_id", "n_bytes").repartition("word")
               .sortWithinPartitions("word").mapInArrow(run, "row long, doc_id long, n_bytes long, n_tokens long"))
    return (counted.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                       F.sum("n_tokens").alias("n_tokens")).drop("row"))
