"""Problem 6: the ids of a public byte-level BPE tokenizer for every text of a corpus.

Method: per-prefix dynamic programming. For every prefix of a piece of text there is exactly one token that can be the last of its
encoding. The tokens that end at a position are read off an automaton that follows suffix links; of these the longest is taken that
is compatible with the last token of the prefix before it, that is, whose pair the merge order would leave as it is. Back-pointers
from the end give the ids. Time is linear in the length of a piece, however long, unlike repeated merging.

A text is first cut into pieces by the tokenizer's public pattern. Equal pieces recur, so each Python worker remembers pieces it has
encoded, up to a bound. The vocabulary is broadcast: it is a file of fixed size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from pathweave.runtime import ship, spread

#: Where the public vocabulary files are.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that cuts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers, and the longest that it does: some tens of MB.
REMEMBERED, REMEMBERED_BYTES = 100_000, 64
#: Pair tests a worker remembers: 200,000 of some 200 bytes each, 40 MB.
REMEMBERED_PAIRS = 200_000
#: Characters of text in one Arrow batch of results.
BATCH = 2_000_000

_NONE = 1 << 30


class Tokenizer:
    """Exact byte-level BPE by dynamic programming over prefixes. ranks: the bytes of each token by its id, in merge order."""

    def __init__(self, ranks: list[bytes], pattern: str = PATTERN):
        self.tokens = ranks
        self.ids = {t: i for i, t in enumerate(ranks)}
        self.cut = regex.compile(pattern)
        self.halves: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        self.compatible_memo: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(ranks):
            pair = self._split(i, t)
            self.halves.append(pair)
            if pair[0] != i:
                self.merged[pair] = i
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for i, t in enumerate(ranks):
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.seen: dict[str, tuple[int, ...]] = {}

    def _split(self, i: int, t: bytes) -> tuple[int, int]:
        """The two tokens that merge into token i (itself twice for one byte): the split whose halves the earlier merges keep apart."""
        if len(t) == 1:
            return i, i
        ids, best = self.ids, None
        for k in range(1, len(t)):
            a, b = ids.get(t[:k]), ids.get(t[k:])
            if a is not None and b is not None and a < i and b < i and self.compatible(a, b):
                if best is not None:
                    raise ValueError(f"token {i} has two splits")
                best = a, b
        if best is None:
            raise ValueError(f"token {i} can't be merged from earlier tokens")
        return best

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the text of a and b together gives a and b again.

        The boundary between them is undone step by step, last merge first: at each step the side whose token was merged later is
        split, and if the tokens then touching would have merged before that, the boundary doesn't hold.
        """
        key = (a, b)
        known = self.compatible_memo.get(key)
        if known is not None:
            return known
        halves, merged, limit, ok = self.halves, self.merged, _NONE, True
        x, y = a, b
        while True:
            m = merged.get((x, y))
            if m is not None and m < limit:
                ok = False
                break
            if x > y:  # x was merged later: look at its right part
                limit, inner = x, halves[x][1]
                if inner != x:
                    x = inner
                    continue
                limit, inner = y + 1, halves[y][0]
                if inner == y:
                    break
                y = inner
            else:
                limit, inner = y + 1, halves[y][0]
                if inner != y:
                    y = inner
                    continue
                limit, inner = x, halves[x][1]
                if inner == x:
                    break
                x = inner
        if len(self.compatible_memo) >= REMEMBERED_PAIRS:
            self.compatible_memo.clear()
        self.compatible_memo[key] = ok
        return ok

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece."""
        known = self.seen.get(text)
        if known is not None:
            return known
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.ids.get(raw)
        if whole is not None:
            out = (whole,)
        else:
            last = [0] * (len(raw) + 1)  # the last token of each prefix
            sizes = [0] * (len(raw) + 1)
            settled, compatible = 0, self.compatible
            # for one end after the other, longest match first
            for end, (token, size) in self.automaton.iter(raw.decode("latin-1")):
                end += 1
                if settled == end:
                    continue
                start = end - size
                if start == 0 or compatible(last[start], token):
                    last[end], sizes[end], settled = token, size, end
            back, at = [], len(raw)
            while at:
                back.append(last[at])
                at -= sizes[at]
            out = tuple(reversed(back))
        if len(raw) <= REMEMBERED_BYTES:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[text] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; none for a null or empty text."""
        out: list[int] = []
        if text:
            piece = self.piece
            for p in self.cut.findall(text):
                out += piece(p)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


def read_vocabulary(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file (base64 and rank a line) by rank, which must count up from 0."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks have gaps")
    return [t for _, t in pairs]


_loaded: dict[str, Tokenizer] = {}


def tokenizer(ranks: list[bytes]) -> Tokenizer:
    """The worker's own, built once for each vocabulary."""
    key = hashlib.md5(b"\0".join(ranks)).hexdigest()
    if key not in _loaded:
        _loaded[key] = Tokenizer(ranks)
    return _loaded[key]


_sent: dict[tuple[str, str], Broadcast] = {}


def vocabulary(spark: SparkSession, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Broadcast:
    """The vocabulary, broadcast once per application (0.8 MB, whatever the corpus)."""
    key = (spark.sparkContext.applicationId, f"{folder}/{name}")
    if key not in _sent:
        _sent[key] = spark.sparkContext.broadcast(read_vocabulary(f"{folder}/{name}"))
    return _sent[key]


def _encode(ranks: Broadcast, lengths_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
        """A batch in parts of bounded text: one very long text is a part of its own."""
        texts = batch.column(1).to_pylist()
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= BATCH:
                yield batch.column(0).slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0
        if at < len(texts) or not texts:
            yield batch.column(0).slice(at), texts[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks.value)
        for batch in batches:
            for ids, texts in slices(batch):
                encoded = [t.encode(x) for x in texts]
                if lengths_only:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(map(len, encoded), pa.int32())], ["doc_id", "n_tokens"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(encoded, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode_corpus(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """p6: (doc_id, ids), one row per row of documents (doc_id, text).

    ids are those of the named vocabulary without special tokens; strings of special tokens in a text are ordinary text. Null and empty
    texts have an empty list. Extra columns are ignored; equal texts get equal lists; texts are encoded whole, however long.
    """
    spark = documents.sparkSession
    ship(spark)
    return spread(documents.select("doc_id", "text")).mapInArrow(_encode(vocabulary(spark, folder, name), False), "doc_id bigint, ids array<int>")


def _decode(ranks: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(ranks.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or []) for x in batch.column(1).to_pylist()], pa.large_string()).cast(pa.string())], ["doc_id", "text"])

    return run


def decode_corpus(encoded: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of encoded (doc_id, ids): the texts that the ids stand for; '' for none."""
    spark = encoded.sparkSession
    ship(spark)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(vocabulary(spark, folder, name)), "doc_id bigint, text string")


def count_tokens(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document, 0 for null and empty texts."""
    spark = documents.sparkSession
    ship(spark)
    return spread(documents.select("doc_id", "text")).mapInArrow(_encode(vocabulary(spark, folder, name), True), "doc_id bigint, n_tokens int")
