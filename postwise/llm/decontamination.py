"""Benchmark decontamination: passages of documents within edit distance of a benchmark item.

Texts are word sequences (runs of letters, digits and non-ASCII characters, lower-cased). An item of
n words leaks where a passage has a word edit distance of at most ``(1 - similarity) * n``.

1. Window starts. With k edits, one of the first k + 1 disjoint word pairs of the item is untouched.
   So a leak has a place where a pair from the head of the item stands in the document, and windows begin
   at these places only; the item is embedded from each of these pairs on. No leak is lost by it.
2. Embedding. The CGK random walk reads the window: step j writes the present word and moves on if a
   random bit of (j, word) is set. Edit distance becomes Hamming distance of the writings. Words of
   no item have codes of their own, so the walk moves on over them as well.
3. Bit-sampling LSH. Each table samples up to ``SAMPLED`` of the first steps of one walk; a window meets
   the items with equal words there. How far the steps reach and how many walks there are is chosen per
   size class of items: the most selective setting that finds ``RECALL`` of copies of its own items
   planted among foreign words with all allowed edits. ``tests/llm`` measures the recall.
4. Verification. Every candidate is checked by the exact edit distance of item and passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.llm.common import attach, boxed, inside, table
from postwise.llm.licenses import WORD_BYTES

SIMILARITY = 0.8
TABLES, SAMPLED = 4, 3
# Last step that tables sample and number of walks, the most selective first; without steps a word pair is enough.
SETTINGS = [(12, 8), (8, 8), (6, 8), (5, 8), (4, 8), (3, 8), (2, 8), (1, 4), (0, 1)]
# Share of the planted copies, for each way to place the edits, that the tables of a class have to find.
RECALL, COPIES = 0.998, 500
# Text of the items that one pass over the documents looks for; more items take more passes.
BLOCK_BYTES = 8 << 20
SEED = 71
CODE = 0x9E3779B1


def words_of(body: bytes) -> list[bytes]:
    if not body.isascii():
        body = body.decode("utf-8", "replace").lower().encode()
    return body.translate(WORD_BYTES).split()


def allowed_edits(size: int, similarity: float) -> int:
    return int(np.floor(round((1 - similarity) * size, 9)))


class Search:
    """Benchmark items compiled for searching texts."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float = SIMILARITY) -> None:
        if not 0 < similarity <= 1:
            raise ValueError("similarity must be in (0, 1]")
        lists = [(number, words_of(text)) for number, text in items]
        lists = [(number, words) for number, words in lists if words]
        vocabulary = sorted({w for _, words in lists for w in words})
        # Odd multiples are distinct and spread over 31 bits. Words of items get odd codes, others even ones; 0 is no word.
        self.codes = {w: (i * CODE) % (1 << 31) * 2 + 1 for i, w in enumerate(vocabulary, 1)}
        self.items = [(number, [self.codes[w] for w in words]) for number, words in lists]
        self.edits = [allowed_edits(len(codes), similarity) for _, codes in self.items]
        self.masks = []
        for _, codes in self.items:
            mask: dict[int, int] = {}
            for i, c in enumerate(codes):
                mask[c] = mask.get(c, 0) | 1 << i
            self.masks.append(mask)
        rng = np.random.default_rng(SEED)
        self.classes = [self._class(rng, low, rests) for low, rests in sorted(self._rests().items())]

    def _rests(self) -> dict[int, list[tuple[int, int]]]:
        """Item rests (item, offset) that windows are compared with, by the power of two of the item's size."""
        found: dict[int, list[tuple[int, int]]] = {}
        for i, (_, codes) in enumerate(self.items):
            low = 1 << (len(codes).bit_length() - 1)
            found.setdefault(low, []).extend((i, offset) for offset in self._heads(i))
        return found

    def _heads(self, item: int) -> range:
        return range(min(2 * self.edits[item] + 2, max(1, len(self.items[item][1]) - 1)))

    def _class(self, rng: np.random.Generator, low: int, rests: list[tuple[int, int]]) -> dict:
        """Walks and tables for items of ``low`` to ``2 * low - 1`` words."""
        items = sorted({i for i, _ in rests})
        planted = [self._planted(rng, items, way) for way in ("even", "random", "dense")]
        for reach, number in SETTINGS:
            walks = [self._walk(rng, reach, low > 1) for _ in range(number)]
            if all(self._found(walks, reach, *copies) >= RECALL for copies in planted):
                break
        flat = np.concatenate([np.array(self.items[i][1][o:] + [0] * (reach + 1), np.uint32) for i, o in rests])
        lengths = [len(self.items[i][1]) - o + reach + 1 for i, o in rests]
        starts = np.cumsum([0, *lengths[:-1]])
        for walk in walks:
            for keys in self._keys(walk, flat, starts):
                order = np.argsort(keys, kind="stable")
                walk["buckets"].append((keys[order], order))
        pairs = sorted({self._pair(self.items[i][1], o) for i, o in rests})
        return {"rests": rests, "walks": walks, "pairs": np.array(pairs, np.uint64), "reach": reach}

    @staticmethod
    def _walk(rng: np.random.Generator, reach: int, paired: bool) -> dict:
        """A walk whose tables sample steps up to ``reach``; step 0 is in the word pair."""
        chosen = {tuple(np.sort(rng.choice(reach, min(SAMPLED, reach), replace=False) + 1).tolist()) for _ in range(TABLES)}
        return {
            "turns": rng.integers(0, 1 << 32, reach + 1, dtype=np.uint32) | np.uint32(1),
            "tables": sorted(chosen),
            "mixers": rng.integers(0, 1 << 63, (len(chosen), reach + 1), dtype=np.uint64) | np.uint64(1),
            "paired": paired,
            "buckets": [],
        }

    def _planted(
        self, rng: np.random.Generator, items: list[int], way: str
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Copies of items with all allowed edits: the codes of copies and items one after another, and per
        untouched head pair the number of the copy, its place in a copy and its place in an item."""
        codes, numbers, places, origins = [0], [], [], []
        pad = max(reach for reach, _ in SETTINGS) + 1
        # Long items make fewer copies, of about a million words together.
        for number in range(max(20, min(COPIES, (1 << 20) // len(self.items[items[0]][1])))):
            item = items[int(rng.integers(len(items)))]
            words, edits = self.items[item][1], self.edits[item]
            size, kinds = len(words), [0] * edits
            if way == "even":
                at = [(j * size + size // 2) // edits for j in range(edits)]
            elif way == "dense":
                # Runs of two words, as far as the edits go.
                at = [3 * j + int(rng.integers(3)) // 2 for j in range(edits)]
            else:
                at = rng.choice(size, edits, replace=False).tolist()
                kinds = rng.integers(0, 3, edits).tolist()
            touched = dict(zip(at, kinds, strict=True))
            foreign = iter((rng.integers(1, 1 << 31, edits + pad) * 2).tolist())
            copy, where = [], {}
            for i, word in enumerate(words):
                # 0 replaces the word, 1 drops it, 2 puts another one before it.
                kind = touched.get(i)
                if kind in (0, 2):
                    copy.append(next(foreign))
                if kind in (None, 2):
                    where[i] = len(copy)
                    copy.append(word)
            first, origin = len(codes), len(codes) + len(copy) + pad
            codes += [*copy, *islice(foreign, pad), *words, *[0] * pad]
            for o in self._heads(item):
                if o in where and (size == 1 or where.get(o + 1) == where[o] + 1):
                    numbers.append(number)
                    places.append(first + where[o])
                    origins.append(origin + o)
        return np.array(codes, np.uint32), np.array(numbers, int), np.array(places, int), np.array(origins, int)

    def _found(
        self, walks: list[dict], reach: int, codes: np.ndarray, numbers: np.ndarray, places: np.ndarray, origins: np.ndarray
    ) -> float:
        """Share of planted copies that share a table entry with their item, of those with an untouched pair."""
        met = np.zeros(len(places), bool)
        for walk in walks:
            for here, there in zip(self._keys(walk, codes, places), self._keys(walk, codes, origins), strict=True):
                met |= here == there
        return len(np.unique(numbers[met])) / max(1, len(np.unique(numbers)))

    @staticmethod
    def _pair(codes: list[int], offset: int) -> int:
        """The word pair at an offset; an item of one word is paired with anything."""
        return codes[offset] << 32 | (codes[offset + 1] if len(codes) > 1 else 0)

    @staticmethod
    def _keys(walk: dict, codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Per table, the word pairs at ``starts`` and the words that the walks write at its sampled steps, as one number."""
        at = starts.copy()
        last = max((int(t[-1]) for t in walk["tables"] if len(t)), default=0)
        head = codes[at].astype(np.uint64) << np.uint64(32)
        if walk["paired"]:
            head |= codes[at + 1]
        keys = [head * mixer for mixer in walk["mixers"][:, 0]]
        for step in range(last + 1):
            word = codes[at]
            for k, sampled in enumerate(walk["tables"]):
                if step in sampled:
                    keys[k] += (word.astype(np.uint64) + np.uint64(1)) * walk["mixers"][k, step]
            at += (word * walk["turns"][step]) >> np.uint32(31)
        return keys

    def _candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, item, offset) of windows that share a table entry with an item."""
        if len(codes) < 2:
            return
        known = codes & 1 == 1
        both = codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:]
        for group in self.classes:
            pairs = group["pairs"]
            single = np.unique(pairs[pairs & np.uint64(0xFFFFFFFF) == 0] >> np.uint64(32)).astype(np.uint32)
            places = np.flatnonzero(known[:-1] & known[1:])
            places = places[_in_sorted(pairs, both[places])]
            if len(single):
                places = np.union1d(places, np.flatnonzero(_in_sorted(single, codes[:-1])))
            if not len(places):
                continue
            padded = np.concatenate([codes, np.zeros(group["reach"] + 1, np.uint32)])
            seen: set[tuple[int, int]] = set()
            for walk in group["walks"]:
                for keys, (sorted_keys, order) in zip(
                    self._keys(walk, padded, places), walk["buckets"], strict=True
                ):
                    first = np.searchsorted(sorted_keys, keys, side="left")
                    end = np.searchsorted(sorted_keys, keys, side="right")
                    for k in np.flatnonzero(end > first).tolist():
                        for r in order[first[k] : end[k]].tolist():
                            seen.add((int(places[k]), r))
            for place, r in sorted(seen):
                item, offset = group["rests"][r]
                yield place, item, offset

    def find(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """Per text, the leaks (item number, first word, end word, edits): the best place of each item."""
        get, lists = self.codes.get, []
        for body in texts:
            words = words_of(body)
            codes = np.fromiter(map(get, words, repeat(0)), np.uint32, len(words))
            # Other words get even codes of their own, which equal no word of an item.
            other = np.flatnonzero(codes == 0)
            if len(other):
                hashed = np.fromiter(map(crc32, map(words.__getitem__, other.tolist())), np.uint32, len(other))
                codes[other] = np.maximum(hashed & np.uint32(0xFFFFFFFE), np.uint32(2))
            lists.append(codes)
        # One array with a gap behind each text, so that no pair spans two texts.
        gap = np.zeros(1, np.uint32)
        codes = np.concatenate([x for c in lists for x in (c, gap)]) if lists else gap
        begins = np.cumsum([0] + [len(c) + 1 for c in lists])
        wanted: dict[tuple[int, int], set[int]] = {}
        for place, item, offset in self._candidates(codes):
            text = int(np.searchsorted(begins, place, side="right")) - 1
            wanted.setdefault((text, item), set()).add(place - offset)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for (text, item), starts in sorted(wanted.items()):
            best = self._best(codes, int(begins[text]), int(begins[text + 1]) - 1, item, starts)
            if best is not None:
                out[text].append((self.items[item][0], *best))
        return out

    def _best(self, codes: np.ndarray, low: int, high: int, item: int, starts: set[int]) -> tuple[int, int, int] | None:
        words, mask, most, best = self.items[item][1], self.masks[item], self.edits[item], None
        size = len(words)
        # A literal copy needs no search.
        for start in sorted(starts):
            if low <= start and start + size <= high and codes[start : start + size].tolist() == words:
                return start - low, start + size - low, 0
        for start in sorted(starts):
            begin = max(low, start - most)
            window = codes[begin : min(high, start + size + most)].tolist()
            # Each word of the item that the passage lacks costs an edit.
            if sum(map(mask.__contains__, window)) < size - most:
                continue
            edits, end = _least_edits(mask, size, window)
            if edits <= most and (best is None or edits < best[2]):
                # The same search backwards from the end finds the begin.
                turned = {c: int(bin(m + (1 << size))[3:][::-1], 2) for c, m in mask.items()}
                _, length = _least_edits(turned, size, window[:end][::-1])
                best = (begin + end - length - low, begin + end - low, edits)
                if edits == 0:
                    break
        return best


def _in_sorted(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(values, wanted)
    at[at == len(values)] = 0
    return values[at] == wanted if len(values) else np.zeros(len(wanted), bool)


def _least_edits(masks: dict[int, int], size: int, text: list[int]) -> tuple[int, int]:
    """Least edits between the whole pattern and any part of ``text``, and where the first such part ends.

    Bit-parallel: one integer holds the vertical differences of a column.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for j, word in enumerate(text, 1):
        equal = masks.get(word, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j
    return best, end


FIELDS = [
    T.StructField(n, T.ArrayType(T.LongType())) for n in ("leak_items", "leak_begins", "leak_ends", "leak_edits")
]


def blocks(items: DataFrame, id_column: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded text, as (id, text in UTF-8); items without words are left out."""
    body = F.col(f"`{text}`").cast("binary")
    rows = items.select(F.col(f"`{id_column}`").alias("id"), body.alias("body")).filter("body IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    parts = int(-(-total // BLOCK_BYTES)) or 1
    for part in range(parts):
        mine = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("body"), F.lit(parts)) == part)
        found = sorted(((r["id"], bytes(r["body"])) for r in mine.distinct().collect()), key=lambda x: (x[0] is None, x))
        found = [x for x in found if words_of(x[1])]
        if found:
            yield found


def mark(
    df: DataFrame, block: list[tuple], text: str | tuple[str, int], similarity: float, keep: list[str] | None
) -> DataFrame:
    """``df`` with one entry per leaked item of a block: number in the block, place in words, edits."""
    search = Search([(n, body) for n, (_, body) in enumerate(block)], similarity)

    def make():
        def run(texts: list[bytes]) -> list:
            found = search.find(texts)
            return [[[leak[k] for leak in leaks] for leaks in found] for k in range(4)]

        return run

    return attach(df, text, FIELDS, make, keep)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row per row of ``docs`` and leaked item, with its best place.

    Columns: the id, the item id, ``first_word`` and ``end_word`` of the passage (words from 0, end exclusive),
    ``edits``, ``n_words`` of the item and ``similarity`` (1 - edits / words). Null and empty texts
    and items have no words and never leak; repeated documents give repeated rows; equal items
    with several ids are all named. Items of fewer than five words leak by equality alone at 0.8.
    """
    spark = docs.sparkSession
    kinds = [docs.schema[id_column].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    out = None
    for block in blocks(items, item_id, item_text):
        names = spark.createDataFrame(
            [(n, i, len(words_of(body))) for n, (i, body) in enumerate(block)], f"_n long, _item {kinds[1]}, _words long"
        )
        found = mark(docs.select(id_column, text), block, text, similarity, [id_column])
        zipped = F.explode(F.arrays_zip(*[f.name for f in FIELDS])).alias("leak")
        rows = found.select(F.col(id_column).alias("_id"), zipped)
        # The names of one block of items are bounded by BLOCK_BYTES.
        rows = rows.join(F.broadcast(names), F.col("leak.leak_items") == F.col("_n")).select(
            F.col("_id").alias(id_column),
            F.col("_item").alias(item_id),
            F.col("leak.leak_begins").alias("first_word"),
            F.col("leak.leak_ends").alias("end_word"),
            F.col("leak.leak_edits").alias("edits"),
            F.col("_words").alias("n_words"),
            (1 - F.col("leak.leak_edits") / F.col("_words")).alias("similarity"),
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        schema = f"`{id_column}` {kinds[0]}, `{item_id}` {kinds[1]}, first_word long, end_word long, edits long"
        out = spark.createDataFrame([], schema + ", n_words long, similarity double")
    return out


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` in which no item leaks, with their columns unchanged."""
    for block in blocks(items, item_id, item_text):
        marked = mark(boxed(docs), block, inside(docs, text), SIMILARITY, ["row"])
        docs = marked.filter(F.size("leak_items") == 0).select("row.*")
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every leak of a benchmark item in a document."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
