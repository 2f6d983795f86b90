"""Encoding of a whole corpus with a public byte-level BPE tokenizer, by higher-order functions.

Texts are cut into words by the tokenizer's pattern. Words that are a token as a whole get their id from
a literal table inside the scan, with no shuffle; these are most words of any corpus. (A vocabulary in which
such a word would not be merged to its token is refused when it is read.) The other words are reduced to
the distinct ones, and only for them the ranked merges are folded over their byte arrays, with
``aggregate`` and ``transform`` on a literal rank map. Their ids are joined back and put between the runs of
known ids of each document. A hot word meets its one id row in a join that adaptive execution splits.

A fold takes time in the square of its length, so words are folded in overlapping windows. A list of tokens
is the encoding of their bytes if and only if each two neighbours are that of theirs; hence, where two
windows have a token in common, the first up to it and the second from it on make the encoding of both. If
neighbours have none in common, the windows grow, at last to the whole word. Time is linear in the length.

Spark searches the entries of a MAP one by one, so both literal maps are arrays in perfect-hash order:
a displacement is looked up by one hash, the entry by the other, and the key stored there is compared.

Null and empty texts give an empty list, blank texts are encoded as they are. Special tokens are
ordinary text. Repeated rows of a document give one row.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.runtime import spread, written

#: Where the vocabulary files of public tokenizers lie; a parameter of everything below.
TOKENIZERS = os.environ.get("TRACEWRIGHT_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
# Fixed value: the tokenizer's splitting pattern, white space spelled out as Unicode has it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
NO_RANK = 1 << 20
#: Bytes of the windows of a word, and of the larger ones where neighbours have no token in common.
WINDOWS = (64, 512, 8192)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def vocabulary(path: str) -> tuple[list[bytes], dict[tuple[int, int], int]]:
    """(bytes of each id, {(left id, right id): merged id}) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    special = [t for t in model["vocab"] if any(c not in letters for c in t)]
    vocab = {t: i for t, i in model["vocab"].items() if t not in special and not (t.startswith("<|") and t.endswith("|>"))}
    tokens = [b""] * (max(model["vocab"].values()) + 1)
    for t, i in vocab.items():
        tokens[i] = bytes(letters[c] for c in t)
    merges: dict[tuple[int, int], int] = {}
    last = -1
    for m in model["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        merged = vocab[left + right]
        if merged <= last:
            raise ValueError("ids must rise with the ranks of the merges")
        last = merged
        merges[vocab[left], vocab[right]] = merged
    by_byte = {t[0]: i for i, t in enumerate(tokens) if len(t) == 1}
    for i in merges.values():
        if merged_ids([by_byte[b] for b in tokens[i]], merges) != [i]:
            raise ValueError(f"token {i} is not what its bytes merge to")
    return tokens, merges


def merged_ids(ids: list[int], merges: dict[tuple[int, int], int]) -> list[int]:
    """The ranked merges of one word, as the definition has them."""
    while len(ids) > 1:
        least = min(merges.get(p, NO_RANK) for p in zip(ids, ids[1:]))
        if least == NO_RANK:
            break
        out: list[int] = []
        i = 0
        while i < len(ids):
            pair = merges.get((ids[i], ids[i + 1])) == least if i + 1 < len(ids) else False
            out.append(least if pair else ids[i])
            i += 2 if pair else 1
        ids = out
    return ids


def _displacements(first: np.ndarray, second: np.ndarray, buckets: int, slots: int) -> np.ndarray:
    """Per bucket a shift that sends all keys to slots of their own."""
    order = np.argsort(first, kind="stable")
    cuts = np.searchsorted(first[order], np.arange(buckets + 1))
    shift = np.zeros(buckets, np.int64)
    taken = np.zeros(slots, bool)
    for b in sorted(range(buckets), key=lambda b: cuts[b] - cuts[b + 1]):
        mine = second[order[cuts[b] : cuts[b + 1]]]
        if not len(mine):
            break
        if len(set((mine % slots).tolist())) < len(mine):
            raise ValueError("two keys of a bucket share a slot")
        d = 0
        while taken[at := (mine + d) % slots].any():
            d += 1
        taken[at] = True
        shift[b] = d
    return shift


def _numbers(values: np.ndarray, kind: str) -> Column:
    """A literal array of numbers: a literal text that the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast(f"array<{kind}>")


def _letters(word: Column) -> Column:
    """The bytes of a word as letters, one each; such texts stay small in plans."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_A, _B, _P = 1_000_003, 754_974_721, 2_147_483_647
_BUCKETS, _SLOTS = 16_384, 131_101


class RankMap:
    """The literal maps of one vocabulary file."""

    def __init__(self, path: str):
        tokens, merges = vocabulary(path)
        keys = np.array([a << 16 | b for a, b in merges], np.int64)
        first, second = (keys * _A) % _P % _BUCKETS, (keys * _B) % _P
        self.pair_shift = _displacements(first, second, _BUCKETS, _SLOTS)
        self.pair_entry = np.full(_SLOTS, -1, np.int64)
        self.pair_entry[(second + self.pair_shift[first]) % _SLOTS] = keys << 17 | np.array(list(merges.values()), np.int64)
        words = []
        for i, t in enumerate(tokens):
            try:
                words.append((t.decode("utf-8"), i))
            except UnicodeDecodeError:
                continue
        words = [(w, i) for w, i in words if w and "\x01" not in w]
        hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w, _ in words], np.uint64)
        first, second = (hashes.astype(np.int64) % _BUCKETS), (hashes >> np.uint64(24)).astype(np.int64)
        self.word_shift = _displacements(first, second, _BUCKETS, _SLOTS)
        at = (second + self.word_shift[first]) % _SLOTS
        self.word_id = np.full(_SLOTS, -1, np.int64)
        self.word_id[at] = [i for _, i in words]
        texts = [""] * _SLOTS
        for slot, (w, _) in zip(at.tolist(), words):
            texts[slot] = w
        self.word_text = "\x01".join(texts)
        by_byte = {t[0]: i for i, t in enumerate(tokens) if len(t) == 1}
        self.byte_id = np.array([by_byte[b] for b in range(256)], np.int64)
        self.token_size = np.array([len(t) for t in tokens], np.int64)

    def word_tokens(self, words: Column) -> Column:
        """Of an array of words the ids of those that are a token as a whole, else null.

        Hashes and slots are arrays of their own, as an expression used twice is computed twice.
        """
        shift = lambda h: F.get(_numbers(self.word_shift, "int"), F.pmod(h, F.lit(_BUCKETS)).cast("int"))
        slots = F.transform(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.pmod(F.shiftrightunsigned(h, 24) + shift(h), F.lit(_SLOTS)).cast("int"))
        texts, ids = F.split(F.lit(self.word_text), "\x01"), _numbers(self.word_id, "int")
        return F.transform(slots, lambda slot, i: F.when(F.get(texts, slot) == F.get(words, i), F.get(ids, slot)))

    def tables(self, body) -> Column:
        """``body`` of the tables that a fold needs, each of which stands in the plan once."""
        numbers = {"shift": (self.pair_shift, "int"), "entry": (self.pair_entry, "bigint"), "byte": (self.byte_id, "int"), "size": (self.token_size, "int")}
        return _bind(F.struct(*[_numbers(v, kind).alias(k) for k, (v, kind) in numbers.items()]), body)

    @staticmethod
    def merged(t: Column, left: Column, right: Column) -> Column:
        """The id that a pair of ids merges to, which is also its rank; ``NO_RANK`` if it doesn't merge."""
        key = left.cast("bigint") * 65_536 + right
        shift = F.get(t["shift"], F.pmod(F.pmod(key * _A, F.lit(_P)), F.lit(_BUCKETS)).cast("int"))
        entry = F.get(t["entry"], F.pmod(F.pmod(key * _B, F.lit(_P)) + shift, F.lit(_SLOTS)).cast("int"))
        return F.when(F.shiftright(entry, 17) == key, entry.bitwiseAND(131_071).cast("int")).otherwise(F.lit(NO_RANK))

    def fold(self, t: Column, letters: Column) -> Column:
        """The ids of a word: in each step of the fold the merge of least rank is made wherever it stands.

        The ranks of neighbours are carried from step to step; only those beside a merge are looked up.
        """

        def merge_all(ids: Column, ranks: Column, least: Column) -> Column:
            here = lambda i: F.coalesce(F.get(ranks, i) == least, F.lit(False))
            places = F.sequence(F.lit(0), F.size(ids) - 1)
            first = (F.array_position(ranks, least) - 1).cast("int")
            plain = F.transform(places, here)
            # Of a pair of like ids, runs overlap: every second place of a run counts, from its first.
            runs = F.filter(places, lambda i: here(i) & ((i == 0) | ~here(i - 1)))
            second = _bind(runs, lambda r: F.transform(places, lambda i: here(i) & ((i - F.coalesce(F.array_max(F.filter(r, lambda s: s <= i)), F.lit(0))) % 2 == 0)))
            flags = F.when(F.get(ids, first) == F.get(ids, first + 1), second).otherwise(plain)

            def made(f: Column, kept: Column) -> Column:
                now = F.transform(kept, lambda i: F.when(F.get(f, i), least).otherwise(F.get(ids, i)))
                near = lambda k: F.get(f, F.get(kept, k)) | F.get(f, F.get(kept, k + 1))
                return _bind(
                    now,
                    lambda n: F.struct(
                        n.alias("ids"),
                        F.when(
                            F.size(kept) > 1,
                            F.transform(F.sequence(F.lit(0), F.size(kept) - 2), lambda k: F.when(near(k), self.merged(t, F.get(n, k), F.get(n, k + 1))).otherwise(F.get(ranks, F.get(kept, k)))),
                        )
                        .otherwise(F.array().cast("array<int>"))
                        .alias("ranks"),
                    ),
                )

            return _bind(flags, lambda f: _bind(F.filter(places, lambda i: (i == 0) | ~F.get(f, i - 1)), lambda kept: made(f, kept)))

        def step(state: Column, _: Column) -> Column:
            least = F.array_min(state["ranks"])
            return F.when(F.coalesce(least >= NO_RANK, F.lit(True)), state).otherwise(_bind(least, lambda m: merge_all(state["ids"], state["ranks"], m)))

        ranks = lambda ids: F.when(F.size(ids) > 1, F.transform(F.sequence(F.lit(0), F.size(ids) - 2), lambda i: self.merged(t, F.get(ids, i), F.get(ids, i + 1)))).otherwise(F.array().cast("array<int>"))
        start = F.transform(F.regexp_extract_all(letters, F.lit("(?s)."), F.lit(0)), lambda c: F.get(t["byte"], F.ascii(c)))
        zero = _bind(start, lambda ids: F.struct(ids.alias("ids"), ranks(ids).alias("ranks")))
        return F.aggregate(F.sequence(F.lit(1), F.length(letters)), zero, step, lambda s: s["ids"])

    def windowed(self, t: Column, letters: Column, size: Column) -> Column:
        """The ids of a word folded in windows of ``size`` bytes, half of it shared; null where two share no token."""
        half = (size / 2).cast("int")
        count = F.greatest(F.ceil((F.length(letters) - half) / half), F.lit(1)).cast("int")

        def placed(k: Column) -> Column:
            """Tokens of a window as numbers: their places in the word, times 2**17, and their ids."""
            start = F.struct((k * half).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("tokens"))
            step = lambda a, i: F.struct((a["at"] + F.get(t["size"], i)).alias("at"), F.concat(a["tokens"], F.array(F.shiftleft(a["at"], 17) + i)).alias("tokens"))
            return F.aggregate(_bind(F.substring(letters, k * half + 1, size), lambda w: self.fold(t, w)), start, step, lambda a: a["tokens"])

        def stitched(windows: Column) -> Column:
            last = F.size(windows) - 1
            end = F.shiftleft(F.length(letters).cast("bigint"), 17)
            meet = F.transform(F.sequence(F.lit(0), last), lambda k: F.when(k < last, F.array_min(F.array_intersect(F.get(windows, k), F.get(windows, k + 1)))).otherwise(end))

            def joined(m: Column) -> Column:
                part = lambda k: F.filter(F.get(windows, k), lambda t: (t >= F.coalesce(F.get(m, k - 1), F.lit(0))) & (t < F.get(m, k)))
                ids = F.transform(F.flatten(F.transform(F.sequence(F.lit(0), last), part)), lambda t: t.bitwiseAND(131_071).cast("int"))
                return F.when(~F.exists(m, lambda x: x.isNull()), ids)

            return _bind(meet, joined)

        return _bind(F.transform(F.sequence(F.lit(0), count - 1), placed), stitched)

    def pieces(self, word: Column) -> Column:
        """The ids of a word of any length."""
        none = F.lit(None).cast("array<int>")

        def grown(t: Column, letters: Column) -> Column:
            sizes = F.array(*map(F.lit, WINDOWS), F.length(letters) * 2)
            return F.aggregate(sizes, none, lambda got, size: F.when(got.isNotNull(), got).otherwise(_bind(size, lambda s: self.windowed(t, letters, s))))

        return self.tables(lambda t: _bind(_letters(word), lambda letters: grown(t, letters)))


@lru_cache(maxsize=4)
def rank_map(path: str) -> RankMap:
    return RankMap(path)


def _path(tokenizer: str | None) -> str:
    return tokenizer or f"{TOKENIZERS}/{BYTE_BPE}"


def words_of(text: Column) -> Column:
    """The words of a text; none for a null or empty text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def coded_words(documents: DataFrame, ranks: RankMap, key: str, text: str) -> DataFrame:
    """(key, own, runs, lost): the words that are no token as a whole, in order, and the runs of ids before, between and behind them.

    ``own`` is a digest of the text, so that repeated rows of a document are told from others.
    """
    rows = spread(documents.filter(F.col(key).isNotNull()).select(key, text))
    def cut(words: Column, ids: Column, at: Column) -> Column:
        before = lambda k: F.coalesce(F.get(at, k - 1) + 1, F.lit(0))
        after = lambda k: F.coalesce(F.get(at, k), F.size(ids))
        runs = F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: F.slice(ids, before(k) + 1, after(k) - before(k)))
        return F.struct(runs.alias("runs"), F.transform(at, lambda i: F.get(words, i)).alias("lost"))

    # Bound one by one, as the optimizer would write an array's expression into the functions over it.
    nulls = lambda ids: F.filter(F.transform(ids, lambda v, i: F.when(v.isNull(), i)), lambda i: i.isNotNull())
    made = _bind(words_of(F.col(text)), lambda words: _bind(ranks.word_tokens(words), lambda ids: _bind(nulls(ids), lambda at: cut(words, ids, at))))
    return rows.select(key, F.xxhash64(text).alias("own"), made.alias("made")).select(key, "own", "made.runs", "made.lost")


def folded_words(coded: DataFrame, ranks: RankMap) -> DataFrame:
    """(word, pieces) of the distinct words that are no token as a whole."""
    return coded.select(F.explode("lost").alias("word")).distinct().select("word", ranks.pieces(F.col("word")).alias("pieces"))


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every document, without special tokens. Null keys are left out.

    Repeated rows give one row; a key with several texts has a row for each. The words of the texts are
    coded once, as a table in the shared folder; it holds numbers and the words that are no token, and is
    read for the distinct words and again for the documents.
    """
    ranks = rank_map(_path(tokenizer))
    coded = written(coded_words(documents, ranks, key, text), "coded")
    lost = coded.select(key, "own", F.posexplode("lost").alias("at", "word")).join(folded_words(coded, ranks), "word").select(key, "own", F.struct("at", "pieces").alias("found"), F.lit(None).cast("array<array<int>>").alias("runs"))
    known = coded.select(key, "own", F.lit(None).cast(lost.schema["found"].dataType).alias("found"), "runs")
    whole = known.unionAll(lost).groupBy(key, "own").agg(F.first("runs", ignorenulls=True).alias("runs"), F.count("runs").alias("copies"), F.sort_array(F.collect_list("found")).alias("found"))

    def filled(found: Column) -> Column:
        # A row that was there several times has each of its words as often.
        pieces = lambda k: F.when(k > 0, F.get(found, ((k - 1) * F.col("copies")).cast("int"))["pieces"]).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform("runs", lambda run, k: F.concat(pieces(k), run)))

    return whole.select(key, _bind(F.col("found"), filled).alias("ids"))


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(key, tokens): the number of tokens of every document, without putting ids in order."""
    ranks = rank_map(_path(tokenizer))
    coded = written(
        coded_words(documents, ranks, key, text).select(key, "own", F.aggregate("runs", F.lit(0), lambda a, run: a + F.size(run)).alias("known"), "lost"), "coded"
    )
    sizes = folded_words(coded, ranks).select("word", F.size("pieces").alias("tokens"))
    lost = coded.select(key, "own", F.explode("lost").alias("word")).join(sizes, "word").select(key, "own", "tokens", F.lit(0).alias("rows"))
    counted = coded.select(key, "own", F.col("known").alias("tokens"), F.lit(1).alias("rows")).unionAll(lost).groupBy(key, "own").agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
    return counted.select(key, (F.col("tokens") / F.col("rows")).cast("bigint").alias("tokens"))


def decode(encoded: DataFrame, ids: str = "ids", into: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``encoded`` with the text of its ids: their binary pieces concatenated. Null ids give null."""
    tokens, _ = vocabulary(_path(tokenizer))
    pieces = F.split(F.lit(",".join(t.hex() for t in tokens)), ",")
    joined = F.array_join(F.transform(F.col(ids), lambda i: F.get(pieces, i)), "")
    return encoded.withColumn(into, F.when(F.col(ids).isNotNull(), F.unhex(joined).cast("string")))
