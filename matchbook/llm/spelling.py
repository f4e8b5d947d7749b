"""Spelling variants of a corpus's words, by one-edit neighbourhoods in a reduced alphabet.

1. **Words.**  Tasks count the words of whole texts and send partial counts; the vocabulary
   is the words of at least ``MIN_CHARS`` code points and ``MIN_COUNT`` occurrences.
2. **Reduction.**  Letters are hashed to ``SYMBOLS`` symbols, so a word becomes a reduced word
   with a 64-bit polynomial value.  Two words one edit apart have reduced words that are
   equal or one edit apart.
3. **Neighbourhoods.**  Every word's reduced word brings its full one-edit neighbourhood
   (itself, all replacements, deletions and insertions over the small alphabet), computed
   for all words of a length at once from the values of prefixes and suffixes.  A Bloom
   filter of the reduced vocabulary drops what meets no reduced word before the shuffle; it
   loses none.
4. **Join and check.**  Neighbours are joined with the reduced vocabulary, and a pair counts
   if its original strings are exactly one edit (of code points) apart.
5. **Forms.**  A word's form is its most frequent near word, if that is ``RATIO`` times as
   frequent; the root follows forms to the last, by pointer doubling over written tables.

Cases: null and empty texts have no words; a null id counts as an empty one in the hash of
step 1; texts are cut between words into pieces of bounded size, so a text and a word may
have any length; repeated rows count as often as they stand; a word without near words has
n_near 0; of equally frequent near words the smallest in code-point order is the form; an
empty table gives an empty result.  Only the named columns are read, so further columns of
any name are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.common import U64, mix64
from matchbook.session import materialize

MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
SYMBOLS = 8
NOISE = 199                      # one (document, word) in so many loses a letter
PIECE = 1 << 22                  # bytes of a text handled at once
HELD = 200_000                   # distinct words a task holds before it sends them

# The letters: A-Z, a-z and U+00C0 to U+00FF, which UTF-8 writes as C3 and a second byte.
_KEEP = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))
_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
_BLANK = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def words_in(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, A-Z lower-cased, piece by piece."""
    a = 0
    while a < len(text):
        b = min(a + PIECE, len(text))
        if b < len(text):
            gap = _BLANK.search(text, b)
            b = gap.start() if gap else len(text)
        piece = text[a:b]
        if not piece.isascii():
            piece = _OTHER.sub(b" ", piece)
        yield piece.translate(_KEEP).split()
        a = b


def noisy(word: bytes, h: int) -> bytes:
    """The word without its code point h % length."""
    s = word.decode()
    at = h % len(s)
    return (s[:at] + s[at + 1:]).encode()


def _long_enough(word: bytes) -> bool:
    return len(word) >= MIN_CHARS and (word.isascii() or len(word.decode()) >= MIN_CHARS)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): partial counts of each task's words, noise put in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in total], pa.string()),
                 pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                here: Counter = Counter()
                for words in words_in(text.as_buffer().to_pybytes()):
                    here.update([w for w in words if len(w) >= MIN_CHARS])
                for word, n in here.items():
                    h = zlib.crc32(word, start)
                    if h % NOISE == 0:
                        word = noisy(word, h)
                    if _long_enough(word):
                        total[word] += n
                if len(total) >= HELD:
                    yield out()
                    total.clear()
        if total:
            yield out()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least ``min_count`` times."""
    return (count_words(docs, id_col, text_col).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


# ------------------------------------------------------------ reduced neighbourhoods

_BASE = U64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, _BASE, U64)]))


def reduce_words(points: np.ndarray, symbols: int) -> np.ndarray:
    """Symbols (1 to ``symbols``) of code points."""
    return (mix64(points.astype(U64)) % U64(symbols)) + U64(1)


def reduced_keys(reduced: np.ndarray) -> np.ndarray:
    """Value of each reduced word (a row of symbols)."""
    return mix64((reduced * _powers(reduced.shape[1])[:-1]).sum(axis=1, dtype=U64)
                 + U64(reduced.shape[1]))


def neighbour_keys(reduced: np.ndarray, symbols: int) -> np.ndarray:
    """Values of the full one-edit neighbourhood of each reduced word, a row a word; some
    stand twice."""
    m, n = reduced.shape
    power = _powers(n + 1)
    terms = reduced * power[:n]
    before = np.concatenate([np.zeros((m, 1), U64), np.cumsum(terms, axis=1, dtype=U64)], axis=1)
    total = before[:, -1:]
    after = total - before                                  # value of reduced[i:] where it stands
    alphabet = np.arange(1, symbols + 1, dtype=U64)
    inverse = U64(pow(int(_BASE), -1, 1 << 64))
    replaced = (total - terms)[:, :, None] + (power[:n, None] * alphabet[None, :])[None]
    deleted = before[:, :-1] + after[:, 1:] * inverse
    inserted = ((before + after * _BASE)[:, :, None]
                + (power[:n + 1, None] * alphabet[None, :])[None])
    return np.concatenate([mix64(replaced.reshape(m, -1) + U64(n)), mix64(deleted + U64(n - 1)),
                           mix64(inserted.reshape(m, -1) + U64(n + 1))], axis=1)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points) of the words of one length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        step = max(1, (1 << 16) // n)                      # long words go in small steps
        for a in range(0, len(at), step):
            part = at[a:a + step]
            points = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), np.uint32)
            yield part, points.reshape(-1, n)


def with_reduced(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, key): the vocabulary with the value of its reduced words."""
    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            key = np.zeros(len(words), U64)
            for at, points in _by_length(words):
                key[at] = reduced_keys(reduce_words(points, symbols))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(key.view(np.int64))],
                names=["word", "n", "key"])
    return vocab.mapInArrow(run, "word string, n long, key long")


def _bits(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(key.view(U64))
    return (h & U64(size - 1)).astype(np.int64), ((h >> U64(32)) & U64(size - 1)).astype(np.int64)


def key_filter(reduced: DataFrame):
    """Broadcast Bloom filter of the column ``key``: 16 bits a key, between 1 and 32 MB, so a
    larger vocabulary only saves less of the shuffle."""
    n = reduced.count()
    size = 1 << min(28, max(23, (16 * n).bit_length()))

    def fill(batches):
        table = np.zeros(size, bool)
        for batch in batches:
            for cells in _bits(batch.column("key").to_numpy(), size):
                table[cells] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())],
                                         names=["bits"])

    total = np.zeros(size // 8, np.uint8)
    for r in reduced.select("key").coalesce(2).mapInArrow(fill, "bits binary").toLocalIterator():
        total |= np.frombuffer(r["bits"], np.uint8)
    return reduced.sparkSession.sparkContext.broadcast((size, total.tobytes()))


def neighbourhoods(reduced: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, key): every neighbour of a word's reduced word that may be in the reduced
    vocabulary, once a word."""
    wanted = key_filter(reduced)

    def run(batches):
        size, packed = wanted.value
        table = np.frombuffer(packed, np.uint8)
        for batch in batches:
            words, count = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for at, points in _by_length(words):
                keys = neighbour_keys(reduce_words(points, symbols), symbols)
                one, two = (((table[c >> 3] >> (7 - (c & 7))) & 1) for c in _bits(keys.ravel(), size))
                hit = np.flatnonzero(one & two)
                row, key = at[hit // keys.shape[1]], keys.ravel()[hit]
                order = np.lexsort([key, row])
                row, key = row[order], key[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                row, key = row[new], key[new]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("word").take(pa.array(row)), pa.array(count[row]),
                     pa.array(key.view(np.int64))], names=["word", "n", "key"])
    return reduced.mapInArrow(run, "word string, n long, key long")


# --------------------------------------------------------------------- near words

def _shuffled(words: DataFrame) -> DataFrame:
    """A table as long as the vocabulary or longer, as the side of a join: it is never broadcast.
    Spark sizes it by its compressed files, and a table of neighbours by that of their words,
    so it would send one of many times its threshold through the driver."""
    return words.hint("merge")


def near_words(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words that are one edit apart.
    ``vocab`` is a written table."""
    reduced = materialize(with_reduced(vocab, symbols), "reduced-words")
    other = reduced.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    return (_shuffled(neighbourhoods(reduced, symbols)).join(_shuffled(other), "key")
            .where((F.col("word") != F.col("near"))
                   & (F.abs(F.length("word") - F.length("near")) <= 1)
                   & (F.levenshtein("word", "near", 1) == 1))
            .select("word", "n", "near", "near_n"))


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form (word, form): the last of the chain, by pointer
    doubling.  A form is more frequent than its word, so chains end."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
        on = F.col("root") == F.col("w")
        if now.join(_shuffled(step), on, "left_semi").isEmpty():
            return now
        now = materialize(now.join(_shuffled(step), on, "left").select(
            "word", F.coalesce("further", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of every word of the vocabulary."""
    vocab = materialize(vocabulary(docs, id_col, text_col), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    found = near_words(vocab, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.m") >= RATIO * F.col("n")
    words = materialize(
        vocab.join(_shuffled(found), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.w")).alias("form"),
            F.when(is_form, -F.col("best.m")).alias("form_n")), "forms")
    roots = follow_forms(words.where("form IS NOT NULL"))
    return words.join(_shuffled(roots), "word", "left").select(
        "word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
