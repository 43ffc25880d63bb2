"""Language-model scoring by online logistic context mixing.

A text is a sequence of words and one end. Each token is a path of binary decisions: a Huffman code of
its class (unknown, end, a set of frequent words, or a band of word counts), then the bits of its place
in the set of frequent words; or the bits of its group in the band (by its ending) and its share c / C
of that group; or, for an unknown word, the bits of its bytes. Each decision is predicted from several
contexts (none, the last token, the last two tokens, the last two frequent words; for bytes the last
one, two and three bytes). A context and the node of the decision are hashed to a slot with two
counts. The predictions, as log odds, are summed with weights that a gate chooses by the confidence of
the contexts; the weights are learned online, decision by decision in small batches, and a last table,
adapted in the same pass, refines the mixed probability. The logarithms add up to the probability of
the text and its bits per byte.

On Spark: word counts come from all training rows. Documents are dealt to blocks, and a block gets the
counts of its own words by joins on the word, so no task or broadcast holds the vocabulary, and texts
are shuffled once. The counts of the slots are sums of arrays over all training rows; the arrays grow with
the training tokens up to a bound in bytes. Only those, the most frequent words and the band totals are broadcast.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.llm.common import give_back, remainder, stored, table, text_bytes, whole_text

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# Words with a code of their own; the rest is coded by the band of its count.
HEAD = 2047
# Bands by doubling count, each in groups by the last two bytes of the word.
BANDS, GROUP_BITS = 51, 4
GROUPS = 1 << GROUP_BITS
BAND = 2048
UNKNOWN, END = BAND + BANDS * GROUPS, BAND + BANDS * GROUPS + 1
# Marks a count that leaving out one occurrence moves to the next lower band.
LOWERED = 0x8000
CONTEXTS, CHUNK = 4, 1 << 14
# Decisions whose slots are worked out at once, a multiple of those learned from at once: their arrays stay in the processor's cache.
PART = 1 << 13
# Slots of a context: at least 16 per training token, about one per decision, between these powers of two. The upper one bounds what is
# broadcast: 64 MB while weights are learned, 32 MB when texts are scored.
LEAST_BITS, MOST_BITS = 16, 22
GATES, KINDS, CELLS = 64, 3, 32
# Passes over all training rows that fit the gated weights and the refinement.
ROUNDS = 1
# Input bytes whose distinct words a task holds at once; larger input splits are cut into several blocks.
BLOCK_BYTES = 16 << 20
# Counts of words that a task holds before it adds them up, and passes them on if most differ.
HELD_WORDS = 1_600_000
SMOOTH = 0.1


def group_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % GROUPS


# Bytes of text cut into words at once.
CUT_BYTES = 4 << 20
# Lower case, and every blank as a space.
PLAIN = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in LOWER)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``CUT_BYTES`` bytes."""
    ends = np.cumsum([len(t) + 1 for t in text_bytes(texts)])
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CUT_BYTES, "right")))
        yield at, upto
        at = upto


def cut(bodies: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, each with one space behind it, the number of the word at every place, and the words per text."""
    plain = np.frombuffer(b"\n".join([*bodies, b""]).translate(PLAIN), np.uint8)
    blank = plain == 32
    # Every word is followed by a blank; other blanks are left out.
    last = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    ends = np.cumsum([len(b) + 1 for b in bodies])
    sizes = np.diff(np.searchsorted(last, ends), prepend=0)
    if np.count_nonzero(blank) > len(last):
        kept = ~blank
        kept[last] = True
        last = np.cumsum(kept)[last] - 1
        plain = plain[kept]
    offsets = np.append(0, last + 1).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(last), [None, pa.py_buffer(offsets), pa.py_buffer(plain)])
    found = words.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), sizes


def _parts(words: pa.Array, behind: int) -> tuple[memoryview | bytes, np.ndarray, np.ndarray]:
    """Bytes of some words, and where each begins and ends; the last ``behind`` bytes of a word are left out."""
    words = words.cast(pa.binary())
    if not len(words):
        return b"", np.empty(0, np.int32), np.empty(0, np.int32)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return words.buffers()[2], offsets[:-1], offsets[1:] - behind


def listed(words: pa.Array, behind: int = 0) -> list[bytes]:
    """Words as Python objects: cut from one piece of memory, far faster than one by one from Arrow."""
    data, starts, ends = _parts(words, behind)
    if not len(starts):
        return []
    first = int(starts[0])
    data = bytes(memoryview(data)[first : int(ends[-1])])
    return [data[a:b] for a, b in zip((starts - first).tolist(), (ends - first).tolist(), strict=True)]


def groups_of(words: pa.Array, behind: int = 0) -> np.ndarray:
    """``group_of`` of many words, worked out once for each ending."""
    data, starts, ends = _parts(words, behind)
    if not len(starts):
        return np.empty(0, np.int64)
    data = np.frombuffer(data, np.uint8)
    before = np.where(ends - starts > 1, data.take(ends - 2, mode="clip").astype(np.int64) << 8, 1 << 16)
    endings, which = np.unique(before | data.take(ends - 1), return_inverse=True)
    groups = [group_of(bytes([e & 255]) if e >> 16 else bytes([e >> 8, e & 255])) for e in endings.tolist()]
    return np.array(groups, np.int64).take(which)


# --- decisions -----------------------------------------------------------------------------------


def huffman(masses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths of the classes: node ids, bits and lengths; ties fall to the smaller class."""
    n = len(masses)
    heap = [(float(m), i, i) for i, m in enumerate(masses)]
    heapq.heapify(heap)
    children, fresh = {}, n
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[fresh] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    paths: dict[int, list[tuple[int, int]]] = {heap[0][2]: []}
    for node in sorted(children, reverse=True):
        for bit, child in enumerate(children[node]):
            paths[child] = [*paths[node], (node - n, bit)]
    depth = np.array([len(paths[i]) for i in range(n)], np.int32)
    nodes = np.zeros((n, depth.max()), np.int64)
    bits = np.zeros((n, depth.max()), np.int8)
    for i in range(n):
        for d, (node, bit) in enumerate(paths[i]):
            nodes[i, d], bits[i, d] = node, bit
    return nodes, bits, depth


CLASSES = 64
FIRST_BAND = 13


def class_of(codes: np.ndarray) -> np.ndarray:
    """0 unknown, 1 end, 2 to 12 groups of frequent words by doubling rank, from 13 on the bands."""
    rank = np.maximum(codes.astype(np.int64) + 1, 1)
    group = np.frexp(rank.astype(np.float64))[1] + 1
    band = FIRST_BAND + ((codes.astype(np.int64) - BAND) >> GROUP_BITS)
    out = np.where(codes < HEAD, group, band)
    return np.where(codes == UNKNOWN, 0, np.where(codes == END, 1, out))


def _mix(*parts: np.ndarray | int, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of several integer columns; ``total`` is that of the first one, where it is known."""
    known = total is not None
    total = total if known else np.uint64(0x2545F4914F6CDD1D)
    for k, part in enumerate(parts, known):
        total = (np.asarray(part).astype(np.uint64) + total) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        total = total ^ (total >> np.uint64(29))
    return total


def _short(hashed: np.ndarray) -> np.ndarray:
    """The upper half of a 64-bit hash."""
    return (hashed >> np.uint64(32)).astype(np.uint32)


def _node_hash(nodes: np.ndarray) -> np.ndarray:
    return _short(nodes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _slots(contexts: list[np.ndarray], rows: np.ndarray | None, node: np.ndarray, bits: int) -> list[np.ndarray]:
    """Slot of every decision in the table of each context; ``contexts`` and ``node`` are 32-bit hashes, ``rows`` None takes all in turn."""
    shift, out = np.uint32(32 - bits), []
    for c in contexts:
        mixed = c ^ node if rows is None else c.take(rows, mode="clip") ^ node
        mixed *= np.uint32(0x9E3779B1)
        mixed >>= shift
        out.append(mixed.astype(np.intp))
    return out


# First steps of the hash of a code, and its context hash where it is the only part.
FIRST_MIX = _mix(np.arange(END + 1))
ALONE_MIX = _short(_mix(1, total=FIRST_MIX))
NO_MIX = _short(_mix(np.zeros(1, np.int64), 0))


def _token_contexts(codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Context hashes of every token; contexts do not reach over the start of a text."""
    n = len(codes)
    place = np.arange(n)
    since = place - np.repeat(starts, np.diff([*starts, n]))
    plain = codes.astype(np.int64)

    def back(values: np.ndarray, steps: int) -> np.ndarray:
        out = np.full(n, END, np.int64)
        out[steps:] = values[:-steps] if steps else values
        return np.where(since >= steps, out, END)

    one, two = back(plain, 1), back(plain, 2)
    # The last frequent word before each token, and the one before that.
    frequent = plain < 256
    seen = np.maximum.accumulate(np.where(frequent, place, -1))
    last = np.full(n, -1)
    last[1:] = seen[:-1]
    first = np.repeat(starts, np.diff([*starts, n]))
    ok = last >= first
    fw1 = np.where(ok, plain[np.maximum(last, 0)], END)
    before = np.where(ok, np.maximum(last, 0), 0)
    last2 = np.where(ok, last[before], -1)
    fw2 = np.where(last2 >= first, plain[np.maximum(last2, 0)], END)
    pairs = [_short(_mix(b, mark, total=FIRST_MIX.take(a))) for a, b, mark in ((one, two, 2), (fw1, fw2, 3))]
    return [np.repeat(NO_MIX, n), ALONE_MIX.take(one), *pairs]


def _byte_contexts(codes: np.ndarray) -> list[np.ndarray]:
    """Context hashes of every byte of the unknown words: its last one, two, three and five; each word ends with a space."""
    plain = np.concatenate([[32] * 5, codes]).astype(np.int64)
    back = [plain[4:-1]]
    for k in range(1, 5):
        # Nothing before the word counts.
        back.append(np.where(back[-1] == 32, 32, plain[4 - k : len(plain) - 1 - k]))
    return [_short(_mix(*back[:n], 3 + n)) for n in (1, 2, 3, 5)]


class Coder:
    """Turns coded texts into decisions: slots of all contexts, bit, kind and owner."""

    def __init__(self, masses: np.ndarray, slot_bits: int) -> None:
        nodes, bits, self.depth = huffman(masses)
        self.classes = class_of(np.arange(END + 1))
        self.slot_bits = slot_bits
        # Hashed node, bit and slot without a context of every step, by class, by frequent word, by group and by byte.
        self.class_steps = [self._step(n, b) for n, b in zip(nodes.T, bits.T, strict=True)]
        number = np.arange(HEAD, dtype=np.int64) + 1
        size = class_of(number - 1) - 2
        self.head_size = size
        self.head_steps = []
        for d in range(11):
            left = np.maximum(size - d, 1)
            node = (size << 12) + (number >> left) + 64
            self.head_steps.append(self._step(node, (number >> (left - 1)) & 1))
        self.group_steps = self._plain_steps(np.arange(GROUPS, dtype=np.int64) | GROUPS, GROUP_BITS, 1 << 20)
        self.byte_steps = self._plain_steps(np.arange(256, dtype=np.int64) | 256, 8, 65536)

    def _step(self, nodes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashed = _node_hash(nodes)
        alone = _slots([NO_MIX], None, hashed, self.slot_bits)[0]
        return hashed, bits.astype(np.int8), alone

    def _plain_steps(self, values: np.ndarray, size: int, offset: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        places = range(size - 1, -1, -1)
        return [self._step((values >> (at + 1)) + offset, (values >> at) & 1) for at in places]

    def _token_steps(
        self, codes: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], int]]:
        """Tokens that take a step, their places in the tables of the step, the tables, and the kind."""
        rows, c = np.arange(len(codes)), self.classes.take(codes)
        sizes = self.depth.take(c)
        for kind, steps in enumerate((self.class_steps, self.head_steps)):
            if kind:
                rows = np.flatnonzero((codes < HEAD) & (codes > 0))
                c = codes.take(rows).astype(np.intp)
                sizes = self.head_size.take(c)
            for d, step in enumerate(steps):
                inside = np.flatnonzero(sizes > d)
                if len(inside) < len(rows):
                    rows, c, sizes = (x.take(inside, mode="clip") for x in (rows, c, sizes))
                if not len(rows):
                    break
                yield rows, c, step, kind
        rows = np.flatnonzero((codes >= BAND) & (codes < UNKNOWN))
        c = (codes.take(rows).astype(np.intp) - BAND) % GROUPS
        for step in self.group_steps if len(rows) else ():
            yield rows, c, step, 1

    def decisions(
        self, codes: np.ndarray, starts: np.ndarray, spelled: np.ndarray, owners: np.ndarray
    ) -> Iterator[tuple[list[np.ndarray], np.ndarray, int, np.ndarray]]:
        """Batches of (slots per context, bits, kind, text number).

        ``codes`` and ``starts``: the tokens of several texts; ``spelled`` and ``owners``: the bytes of
        their unknown words and the text number of each.
        """
        if len(codes):
            text = np.repeat(np.arange(len(starts)), np.diff([*starts, len(codes)]))
            contexts = _token_contexts(codes, starts)[1:]
            for every, places, (nodes, bits, alone), kind in self._token_steps(codes):
                for at in range(0, len(every), PART):
                    rows, c = every[at : at + PART], places[at : at + PART]
                    slots = _slots(contexts, rows, nodes.take(c, mode="clip"), self.slot_bits)
                    yield [alone.take(c, mode="clip"), *slots], bits.take(c, mode="clip"), kind, text.take(rows, mode="clip")
        if len(spelled):
            contexts, letters = _byte_contexts(spelled), spelled.astype(np.intp)
            for nodes, bits, _ in self.byte_steps:
                for part in (slice(at, at + PART) for at in range(0, len(letters), PART)):
                    c = letters[part]
                    slots = _slots([x[part] for x in contexts], None, nodes.take(c, mode="clip"), self.slot_bits)
                    yield slots, bits.take(c, mode="clip"), 2, owners[part]

    def entries(
        self, contexts: list[np.ndarray], codes: np.ndarray, spelling: list[np.ndarray], spelled: np.ndarray
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Context, entries (2 * slot + bit) and how often they come, of all decisions of some tokens and bytes.

        Equal pairs of a context and a token, or a byte, are taken together: their decisions are the same.
        """
        for k in range(CONTEXTS):
            context, code, times = _together(contexts[k], codes)
            for rows, c, (nodes, bits, _), _ in self._token_steps(code) if len(code) else ():
                slots = _slots([context], rows, nodes.take(c, mode="clip"), self.slot_bits)
                yield k, _entry(slots, bits.take(c, mode="clip"))[0], times.take(rows, mode="clip")
            context, letter, times = _together(spelling[k], spelled)
            c = letter.astype(np.intp)
            for nodes, bits, _ in self.byte_steps if len(letter) else ():
                slots = _slots([context], None, nodes.take(c, mode="clip"), self.slot_bits)
                yield k, _entry(slots, bits.take(c, mode="clip"))[0], times


def _together(contexts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a context hash and a code, and the count of each."""
    pairs = (contexts.astype(np.uint64) << np.uint64(16)) | codes.astype(np.uint64)
    pairs.sort()
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
    times, pairs = np.diff(first, append=len(pairs)), pairs.take(first)
    return (pairs >> np.uint64(16)).astype(np.uint32), (pairs & np.uint64(0xFFFF)).astype(np.uint16), times.astype(np.int32)


# --- the mixed model -----------------------------------------------------------------------------


@dataclass
class Model:
    """Log odds and confidence of every slot, gated weights and the refinement table.

    ``slots`` holds one table per context; an entry is the log odds in steps of 1 / ``STEPS`` and, in its
    last two bits, the confidence.
    """

    masses: np.ndarray
    slots: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    def coder(self) -> Coder:
        return Coder(self.masses, self.slots.shape[1].bit_length() - 1)


STEPS = 256


def packed(odds: np.ndarray, confidence: np.ndarray) -> np.ndarray:
    """Log odds, below 2^5 as counts are below 2^40, and confidence in 16 bits."""
    return (np.rint(odds * STEPS).astype(np.int16) << 2) | confidence.astype(np.int16)


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)


def _confidence(total: np.ndarray) -> np.ndarray:
    return ((total >= 1).astype(np.uint8) + (total >= 4) + (total >= 32)).astype(np.uint8)


def _inputs(found: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Log odds per context, and the gate that the confidence of the last three chooses."""
    odds = [(f >> 2).astype(np.float32) * np.float32(1 / STEPS) for f in found]
    gate = ((found[1] & 3) << 4) | ((found[2] & 3) << 2) | (found[3] & 3)
    return odds, gate.astype(np.intp)


def _mixed(weights: np.ndarray, gate: np.ndarray, odds: list[np.ndarray]) -> np.ndarray:
    """Mixed log odds under the weights of one kind, a row per context and one for the constant."""
    out = (weights[CONTEXTS] * np.float32(0.3)).take(gate, mode="clip")
    for row, x in zip(weights, odds, strict=False):
        out += row.take(gate, mode="clip") * x
    np.maximum(out, np.float32(-16), out=out)
    return np.minimum(out, np.float32(16), out=out)


def _cell(mixed: np.ndarray) -> np.ndarray:
    place = mixed + np.float32(8)
    np.maximum(place, np.float32(0), out=place)
    place *= np.float32(CELLS / 16)
    return np.minimum(place, np.float32(CELLS - 1), out=place).astype(np.intp)


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log(1 + np.exp(-np.abs(x)))


def _without(counts: np.ndarray) -> np.ndarray:
    """Packed entries of every slot for either bit without the decision itself: entry 2 * slot + bit of each context."""
    less = np.maximum(counts - 1, 0)
    odds = np.stack([_odds(less[..., 0], counts[..., 1]), _odds(counts[..., 0], less[..., 1])], axis=-1)
    sure = _confidence(np.maximum(counts.sum(axis=-1) - 1, 0))
    return packed(odds, sure[..., None]).reshape(len(counts), -1)


def _slot_table(counts: np.ndarray) -> np.ndarray:
    return packed(_odds(counts[..., 0], counts[..., 1]), _confidence(counts.sum(axis=-1)))


def first_weights() -> np.ndarray:
    """Weights of every kind, context (and the constant) and gate."""
    weights = np.full((KINDS, CONTEXTS + 1, GATES), 0.4)
    weights[:, CONTEXTS] = 0
    return weights


def _entry(slots: list[np.ndarray], bits: np.ndarray) -> list[np.ndarray]:
    """Entry 2 * slot + bit of every decision, in the place of its slot."""
    wide = bits.astype(np.intp)
    for s in slots:
        s <<= 1
        s |= wide
    return slots


def learn(
    batches: Iterator[tuple[list[np.ndarray], np.ndarray, int, np.ndarray]], without: np.ndarray, weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights learned online from where they stand, decisions per gate, and ones and decisions per cell.

    ``without`` leaves each decision out of the counts that predict it.
    """
    weights = weights.copy()
    seen = np.zeros((KINDS, GATES))
    came = np.zeros((KINDS, CELLS * 2))
    for slots, bits, kind, _ in batches:
        own = weights[kind]
        inputs, gates = _inputs([t.take(e) for t, e in zip(without, _entry(slots, bits), strict=True)])
        for at in range(0, len(bits), 4096):
            bit, gate, odds = bits[at : at + 4096], gates[at : at + 4096], [x[at : at + 4096] for x in inputs]
            mixed = _mixed(own.astype(np.float32), gate, odds)
            error = bit - 1 / (1 + np.exp(-mixed))
            here = np.bincount(gate, minlength=GATES)
            rate = 0.02 / np.sqrt(np.maximum(here, 1))
            for row, x in zip(own, odds, strict=False):
                row += rate * np.bincount(gate, error * x, GATES)
            own[CONTEXTS] += rate * 0.3 * np.bincount(gate, error, GATES)
            seen[kind] += here
            came[kind] += np.bincount(_cell(mixed) * 2 + bit, minlength=CELLS * 2)
    pairs = came.reshape(KINDS, CELLS, 2)
    return weights, seen, pairs[..., 1], pairs.sum(axis=-1)


def _refinement(hits: np.ndarray, tries: np.ndarray) -> np.ndarray:
    """Log odds of the ones that came in every cell of mixed log odds; 8 decisions stand for the cell's own."""
    own = 1 / (1 + np.exp(-(np.arange(CELLS) - CELLS / 2 + 0.5) * 16 / CELLS))
    share = (hits + own * 8) / (tries + 8)
    return np.log(share / (1 - share)).astype(np.float32)


def log_probability(
    model: Model, batches: Iterator[tuple[list[np.ndarray], np.ndarray, int, np.ndarray]], texts: int
) -> np.ndarray:
    """Natural logarithms of the probability of the tokens and of the spelling of unknown words, per text."""
    sums = np.zeros((2, texts))
    for slots, bits, kind, text in batches:
        for at in range(0, len(bits), 1 << 14):
            part = slice(at, at + (1 << 14))
            odds, gate = _inputs([t.take(s[part]) for t, s in zip(model.slots, slots, strict=True)])
            mixed = _mixed(model.weights[kind], gate, odds)
            final = (mixed + model.refined[kind].take(_cell(mixed), mode="clip")) * np.float32(0.5)
            # log p of the bit that came: minus softplus of the log odds against it.
            against = final * (1 - 2 * bits[part]).astype(np.float32)
            sums[kind // 2] -= np.bincount(text[part], _softplus(against), texts)
    return sums


# --- gathering on Spark --------------------------------------------------------------------------


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, training occurrences, in a row held out) of every block in the task."""
    held, size = [], 0

    def summed() -> pa.Table:
        sums = pa.concat_tables(held).group_by(["block", "word"], use_threads=False).aggregate([("n", "sum"), ("outside", "any")])
        return sums.select(["block", "word", "n_sum", "outside_any"]).rename_columns(["block", "word", "n", "outside"])

    for batch in batches:
        for at, upto in _pieces(batch.column(2)):
            piece = batch.slice(at, upto - at)
            words, places, sizes = cut(text_bytes(piece.column(2)))
            blocks, block = np.unique(piece.column(0).to_numpy(), return_inverse=True)
            inside = np.repeat(np.array(piece.column(1).to_pylist(), bool), sizes)
            pairs = np.repeat(block * len(words), sizes) + places
            trained = np.bincount(pairs[inside], minlength=len(blocks) * len(words))
            others = np.bincount(pairs[~inside], minlength=len(blocks) * len(words))
            found = np.flatnonzero(trained + others)
            bare = pa.array(listed(words, behind=1), pa.binary())
            held.append(
                pa.table(
                    {
                        "block": pa.array(blocks.take(found // max(len(words), 1))),
                        "word": bare.take(pa.array(found % max(len(words), 1))),
                        "n": pa.array(trained.take(found)),
                        "outside": pa.array(others.take(found) > 0),
                    }
                )
            )
            size += len(found)
            if size > HELD_WORDS:
                held = [summed()]
                size = held[0].num_rows
                if size > HELD_WORDS // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
    if held:
        yield from summed().to_batches()
    held.clear()
    give_back()


CODED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("base_log", T.DoubleType()),
        T.StructField("band_log", T.DoubleType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("codes", T.BinaryType()),
        T.StructField("unknown", T.BinaryType()),
        T.StructField("rare", T.BinaryType()),
    ]
)


def _coder(head: dict[bytes, int], band_totals: np.ndarray, ends_seen: int, width: int):
    """Map function: rows of a block, its word counts first, to coded texts."""

    single = np.zeros(1 << 16, bool)
    single[BAND : BAND + GROUPS] = single[BAND | LOWERED : (BAND | LOWERED) + GROUPS] = True
    lone_share = np.log10(np.maximum(band_totals[0], 1))

    def tables(words: list[pa.Array], numbers: list[np.ndarray]) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of every word of a block; by number, and at the end for other words: code, share, base, whether it is known."""
        totals = np.concatenate([*numbers, [0]]).astype(np.int64)
        groups = np.concatenate([*map(groups_of, words), [0]]).astype(np.int64)
        bands = np.clip(np.frexp(totals.astype(np.float64))[1] - 1, 0, BANDS - 1)
        codes = (BAND + bands * GROUPS + groups).astype(np.uint16)
        codes[totals & (totals - 1) == 0] |= LOWERED
        share = np.log10(np.maximum(totals, 1) / np.maximum(band_totals[bands, groups], 1))
        codes[-1], share[-1] = UNKNOWN, 0
        # A block that was counted in parts lists a word again, with the same count.
        number = dict(zip(chain.from_iterable(map(listed, words)), range(len(totals) - 1), strict=True))
        for w, rank in head.items():
            k = number.get(w)
            if k is not None:
                codes[k], share[k] = rank, 0
        return number, codes, share, np.log10(totals + SMOOTH), totals > 0

    def coded(batch: pa.RecordBatch, known: tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        number, codes, share, base, seen = known
        bodies = text_bytes(batch.column(2))
        learns = np.array(batch.column(4).to_pylist(), bool)
        found, places, sizes = cut(bodies)
        words = listed(found, behind=1)
        texts, none = len(bodies), len(codes) - 1
        row = np.repeat(np.arange(texts), sizes)
        learn = learns.take(row)
        at = np.fromiter(map(number.get, words, repeat(none)), np.int64, len(words))
        # A word of a training row that the counts lack occurs there alone.
        lone = groups_of(found, behind=1)
        absent = (at == none).take(places)
        alone = absent & learn
        at, lone = at.take(places), lone.take(places)
        mine = np.where(alone, ((BAND + lone) | LOWERED).astype(np.uint16), codes.take(at))
        parts = np.where(alone, -lone_share.take(lone), share.take(at))
        bases = base.take(at) + alone * (np.log10(1 + SMOOTH) - np.log10(SMOOTH))

        def spelling(which: np.ndarray) -> list[bytes]:
            out: list[list[bytes]] = [[] for _ in bodies]
            which = np.flatnonzero(which)
            for r, w in zip(row.take(which).tolist(), places.take(which).tolist(), strict=True):
                out[r].append(words[w] + b" ")
            return [b"".join(x) for x in out]

        every = np.full(len(mine) + texts, END, "<u2")
        every[np.arange(len(mine)) + row] = mine
        ends = np.append(0, np.cumsum(sizes + 1) * 2).astype(np.int32)
        made = [
            pa.array(sizes + 1, pa.int64()),
            pa.array(np.bincount(row, seen.take(at) | alone, texts).astype(np.int64) + (ends_seen > 0)),
            pa.array(np.bincount(row, bases, texts) + np.log10(ends_seen + SMOOTH)),
            pa.array(np.bincount(row, parts, texts).astype(np.float64)),
            pa.array([len(b) for b in bodies], pa.int64()),
            pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer(ends), pa.py_buffer(every)]),
            pa.array(spelling(absent & ~learn), pa.binary()),
            # In learning, a word that occurs once is unknown without its own occurrence: it is spelled.
            pa.array(spelling(single.take(mine) & learn), pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[4:width], *made], names=[*batch.schema.names[4:width], *[f.name for f in CODED]]
        )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, words, numbers, known = None, [], [], None
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            changes = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            runs = [0, *changes.tolist(), batch.num_rows] if batch.num_rows else []
            for start, stop in zip(runs, runs[1:], strict=False):
                run = batch.slice(start, stop - start)
                if blocks[start] != block:
                    block, words, numbers, known = blocks[start], [], [], None
                if kinds[start] == 0:
                    words.append(run.column(2))
                    numbers.append(run.column(3).to_numpy())
                    continue
                if known is None:
                    known = tables(words, numbers)
                    words, numbers = [], []
                for at, upto in _pieces(run.column(2)):
                    yield coded(run.slice(at, upto - at), known)

    return code


def _texts(batch: pa.RecordBatch, learning: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and starts of the texts of a batch, the bytes of their unknown words and whose they are.

    For learning, every count is that without the occurrence itself.
    """
    packed, spelled = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    codes = [np.frombuffer(p, "<u2") for p in packed]
    starts = np.cumsum([0, *[len(c) for c in codes[:-1]]])
    joined = np.concatenate(codes)
    lowered = joined >= LOWERED
    joined = joined & 0x7FFF
    if learning:
        without = np.where(joined < BAND + GROUPS, UNKNOWN, joined - GROUPS)
        joined = np.where(lowered, without, joined).astype(np.uint16)
        spelled = batch.column(2).to_pylist()
    letters = np.frombuffer(b"".join(spelled), np.uint8)
    return joined, starts, letters, np.repeat(np.arange(len(spelled)), [len(x) for x in spelled])


# Texts worked on at once where the order of decisions is free: their arrays stay in the processor's cache.
CACHED_ROWS = 64


# Texts whose decisions are learned from step by step together: the order of learning depends on it.
LEARNED_ROWS = 64


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# Tokens and bytes of unknown words whose decisions are counted together.
GATHERED = 1 << 20


def _gathered(
    texts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]],
) -> Iterator[tuple[list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]]:
    """Context hashes and codes of the tokens of many texts, and those of the bytes of their unknown words."""

    def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
        return np.concatenate([np.empty(0, kind), *parts])

    def all_of(held: list) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]:
        tokens, codes, letters, spelled = zip(*held, strict=True)
        over = range(CONTEXTS)
        return (
            [joined([t[k] for t in tokens], np.uint32) for k in over],
            joined(codes, np.uint16),
            [joined([x[k] for x in letters if x], np.uint32) for k in over],
            joined(spelled, np.uint8),
        )

    held, size = [], 0
    for codes, starts, spelled, _ in texts:
        held.append((_token_contexts(codes, starts), codes, _byte_contexts(spelled) if len(spelled) else [], spelled))
        size += len(codes) + len(spelled)
        if size >= GATHERED:
            yield all_of(held)
            held, size = [], 0
    if held:
        yield all_of(held)


PACKED = "chunk int, low binary, places binary, rest binary"


def _pack(chunk: int, counts: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Counts of a chunk: one byte each, and what is above 255 with its places."""
    places = np.flatnonzero(counts > 255)
    low = zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)
    return chunk, low, places.astype("<i4").tobytes(), (counts[places] - 255).astype("<i8").tobytes()


def _unpack(low: bytes, places: bytes, rest: bytes) -> np.ndarray:
    counts = np.frombuffer(zlib.decompress(low), np.uint8).astype(np.int64)
    counts[np.frombuffer(places, "<i4")] += np.frombuffer(rest, "<i8")
    return counts


def _counting(coder: Coder):
    """Map function: coded training texts to packed counts of all slots, one row per chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counts of the table's own type: other ones are added far more slowly.
        total = np.zeros((CONTEXTS, 2 << coder.slot_bits), np.int32)
        used = False
        for held in _gathered(_texts(b, learning=True) for b in _slices(batches, CACHED_ROWS)):
            for k, entry, times in coder.entries(*held):
                used = True
                np.add.at(total[k], entry, times)
        names = [n.split()[0] for n in PACKED.split(", ")]
        chunks = total.reshape(-1, CHUNK * 2) if used else []
        for at in range(0, len(chunks), 64):
            columns = zip(*[_pack(at + k, c) for k, c in enumerate(chunks[at : at + 64])], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(columns)], names=names
            )
        del total, chunks
        give_back()

    return count


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Table entries of the chunks, whose packed counts stand together: without the decision itself, and with all."""
    chunk, total, out = None, None, []

    def add() -> None:
        if chunk is not None:
            pairs = total.reshape(1, -1, 2)
            out.append((chunk, zlib.compress(_without(pairs).tobytes(), 1), zlib.compress(_slot_table(pairs).tobytes(), 1)))

    for batch in batches:
        for c, *parts in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if c != chunk:
                add()
                chunk, total = c, _unpack(*parts)
            else:
                total += _unpack(*parts)
    add()
    columns = list(zip(*out, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(columns)], names=["chunk", "without", "whole"]
    )


def slot_bits(tokens: int) -> int:
    """Bits of a slot number for a training corpus of so many tokens."""
    return min(max(int(tokens).bit_length() + 4, LEAST_BITS), MOST_BITS)


def slot_entries(coded: DataFrame, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """Packed entries of every context, from the zeros and ones of its slots over all training texts.

    The first leaves each decision out (entry 2 * slot + bit), the second has all. The counts are summed and
    turned into entries in the tasks; the driver gets the entries, at most 96 MB.
    """
    rows = coded.filter("_learn").select("codes", "unknown", "rare").mapInArrow(_counting(coder), PACKED)
    chunks = (CONTEXTS << coder.slot_bits) // CHUNK
    summed = rows.repartition(min(chunks, 64), "chunk").sortWithinPartitions("chunk")
    # Written first: an iterator over the driver would run the sums one task after another.
    entries = stored(summed.mapInArrow(_entries, "chunk int, without binary, whole binary"), "entries")
    nothing = np.zeros((1, CHUNK, 2), np.int64)
    without, whole = np.tile(_without(nothing), (chunks, 1)), np.tile(_slot_table(nothing), (chunks, 1))
    for row in entries.toLocalIterator():
        without[row["chunk"]] = np.frombuffer(zlib.decompress(row["without"]), np.int16)
        whole[row["chunk"]] = np.frombuffer(zlib.decompress(row["whole"]), np.int16)
    return without.reshape(CONTEXTS, -1), whole.reshape(CONTEXTS, -1)


@dataclass(frozen=True)
class Corpus:
    """Word statistics of the training rows: tokens, distinct tokens, ends, frequent words, bands."""

    tokens: int
    distinct: int
    ends: int
    head: dict[bytes, int]
    bands: np.ndarray
    masses: np.ndarray


def _corpus(totals: DataFrame, ends: int) -> Corpus:
    """Statistics from the count of every training word; ``HEAD`` words and the sums of all bands reach the driver."""
    sums = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = totals.filter("c >= 2").orderBy(F.desc("c"), "word").limit(HEAD).collect()
    band = F.least(F.length(F.bin("c")) - 1, F.lit(BANDS - 1))
    group = F.crc32(F.expr("substring(word, -2, 2)")) % GROUPS
    rows = totals.groupBy(band.alias("band"), group.alias("group")).agg(F.sum("c").alias("c")).collect()
    bands = np.zeros((BANDS, GROUPS), np.int64)
    for r in rows:
        bands[r["band"], r["group"]] = r["c"]
    masses = np.ones(CLASSES)
    for rank, r in enumerate(top):
        bands[min(int(r["c"]).bit_length() - 1, BANDS - 1), group_of(bytes(r["word"]))] -= r["c"]
        masses[class_of(np.array([rank]))[0]] += r["c"]
    # Words of one occurrence stand for the unknown ones.
    masses[0] += bands[0].sum()
    masses[1] += ends
    for k in range(BANDS):
        masses[FIRST_BAND + k] += bands[k].sum()
    head = {bytes(r["word"]): rank for rank, r in enumerate(top)}
    return Corpus(int(sums[0]) + ends, int(sums[1]) + (ends > 0), ends, head, bands, masses)


def _split_bytes(spark: SparkSession) -> int:
    """Largest split of an input file, as the session has it."""
    text = spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", text).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def score(df: DataFrame, training: Column, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: the id, counts, base score, model score and bits per byte.

    ``training`` picks the rows to learn from. Null texts are empty: they have the end alone.
    ``score`` is the log10 probability of the text: the sum of ``token_score``, over the same events as the base (every
    training word, the end, and one unknown word), and ``spelling_score``, for the letters of the unknown words.
    ``bits_per_byte`` divides the bits of the score by the bytes of the text and is null for an empty one. Without training rows every
    decision has probability one half. Repeated rows stay repeated; other columns are left out.
    """
    spark = df.sparkSession
    pieces = -(-_split_bytes(spark) // BLOCK_BYTES)
    block = F.spark_partition_id() * pieces + F.pmod(F.xxhash64(f"`{id_column}`"), F.lit(pieces))
    parts = df.select(
        block.cast("long").alias("_block"),
        F.coalesce(training, F.lit(False)).alias("_learn"),
        whole_text(text).cast("binary").alias("_body"),
        F.col(f"`{id_column}`").alias("_id"),
    )
    parts = stored(parts, "blocks", "zstd")
    ends = parts.filter("_learn").count()
    words = stored(
        parts.select("_block", "_learn", "_body").mapInArrow(_sum_words, "block long, word binary, n long, outside boolean"),
        "words",
        "zstd",
    )
    totals = stored(words.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "totals")
    corpus = _corpus(totals, ends)
    # A word of a single training row that no held-out row of the block has is known from the row itself.
    once = ((F.col("n") == 1) & ~F.col("outside")).alias("once")
    counts = words.select("block", "word", once).join(totals, "word").filter("NOT (once AND c = 1)")
    kind = parts.schema["_id"].dataType
    both = counts.select(
        F.col("block").alias("_block"),
        F.lit(0).alias("_kind"),
        F.col("word").alias("_body"),
        F.col("c").alias("_count"),
        F.lit(None).cast("boolean").alias("_learn"),
        F.lit(None).cast(kind).alias("_id"),
    ).unionByName(
        parts.select("_block", F.lit(1).alias("_kind"), "_body", F.lit(0).cast("long").alias("_count"), "_learn", "_id")
    )
    most = parts.agg(F.max("_block")).first()[0]
    dealt = both.repartition(max(1, (most or 0) + 1), "_block").sortWithinPartitions(
        # Frequent words first: what is looked up most stands together in memory.
        "_block", "_kind", F.desc("_count"), F.xxhash64("_id"), "_id", "_body"
    )
    schema = T.StructType([T.StructField("_learn", T.BooleanType()), T.StructField("_id", kind), *CODED])
    head = spark.sparkContext.broadcast((corpus.head, corpus.bands, ends))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _coder(*head.value, 6)(batches)

    coded = stored(dealt.mapInArrow(code, schema), "coded", "zstd")
    model = _fit(coded, corpus)
    # Arrays, not the object: what is broadcast is unpickled by workers that may lack this package.
    shared = spark.sparkContext.broadcast((model.masses, model.slots, model.weights, model.refined))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixed = Model(*shared.value)
        coder = mixed.coder()
        for batch in _slices(batches, CACHED_ROWS):
            logs = log_probability(mixed, coder.decisions(*_texts(batch, learning=False)), batch.num_rows)
            names = [*batch.schema.names[3:], "_log", "_spelling"]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(logs[0]), pa.array(logs[1])], names=names)

    kept = ["_learn", "_id", *[f.name for f in CODED if f.name not in ("codes", "unknown", "rare")]]
    rated = coded.select("codes", "unknown", "rare", *kept).mapInArrow(
        rate, T.StructType([coded.schema[c] for c in kept] + [T.StructField(c, T.DoubleType()) for c in ("_log", "_spelling")])
    )
    cost = float(np.log10(corpus.tokens + SMOOTH * (corpus.distinct + 1)))
    tokens, spelling = F.col("_log") / float(np.log(10)) + F.col("band_log"), F.col("_spelling") / float(np.log(10))
    total = tokens + spelling
    bits = F.when(F.col("n_bytes") > 0, -total * float(np.log2(10)) / F.col("n_bytes"))
    return rated.select(
        F.col("_id").alias(id_column),
        (~F.col("_learn")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base_log") - F.col("n_tokens") * cost).alias("base_score"),
        total.alias("score"),
        tokens.alias("token_score"),
        spelling.alias("spelling_score"),
        bits.alias("bits_per_byte"),
    )


def _learning(shared, slot_bits: int, weights: np.ndarray):
    """Map function: coded training texts to the sums of what a task learns, one row per number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masses, without = shared.value
        coder = Coder(masses, slot_bits)
        decisions = (d for b in _slices(batches, LEARNED_ROWS) for d in coder.decisions(*_texts(b, learning=True)))
        found, seen, hits, tries = learn(decisions, without, weights)
        sums = np.concatenate([x.ravel() for x in (found * seen[:, None], seen, hits, tries)])
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], names=["place", "part"])
        give_back()

    return run


def _averaged(sums: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights averaged by the decisions of each gate, and ones and decisions per cell, from summed parts."""
    moved, seen, hits, tries = np.split(sums, np.cumsum([weights.size, KINDS * GATES, KINDS * CELLS]))
    seen = seen.reshape(KINDS, 1, GATES)
    mean = np.where(seen > 0, moved.reshape(weights.shape) / np.maximum(seen, 1), weights)
    return mean, hits.reshape(KINDS, CELLS), tries.reshape(KINDS, CELLS)


def _fit(coded: DataFrame, corpus: Corpus) -> Model:
    """Counts, weights and refinement from all training rows.

    In each round the tasks learn online from the same weights; the next weights are the averages
    of theirs, each gate weighted by its decisions. Ones and decisions per cell are those of the last round.
    """
    coder = Coder(corpus.masses, slot_bits(corpus.tokens))
    without, whole = slot_entries(coded, coder)
    shared = coded.sparkSession.sparkContext.broadcast((corpus.masses, without))
    rows, weights = coded.filter("_learn").select("codes", "unknown", "rare"), first_weights()
    for _ in range(ROUNDS):
        sums = np.zeros(weights.size + KINDS * (GATES + 2 * CELLS))
        parts = rows.mapInArrow(_learning(shared, coder.slot_bits, weights), "place int, part double")
        for r in parts.groupBy("place").agg(F.sum("part").alias("total")).collect():
            sums[r["place"]] = r["total"]
        weights, hits, tries = _averaged(sums, weights)
    shared.destroy()
    return Model(corpus.masses, whole, weights.astype(np.float32), _refinement(hits, tries))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document scored; learned from rows that are not held out."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), remainder("doc_id", 10) != 0)
