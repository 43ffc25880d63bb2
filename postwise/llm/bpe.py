"""BPE as a deterministic tokenization automaton, and tokenizing with it.

Compilation applies the merges in order. Each merge (a, b) -> ab is one gadget on an
automaton over tokens that starts as one state with a loop for every base symbol: the arc
b leaves the state reached by a, and an arc ab is added wherever a was allowed; it leads to
a copy of the state reached by b as it is at that moment. All arcs with one label lead to the
same state, so a state is named by the token that enters it, and each gadget adds one state.
Copies are kept as (parent, time of the copy, own removals); an arc of a state is looked
up through them once and then read from the transition table.

The finished automaton accepts exactly one token path per symbol sequence, and this path is
the BPE segmentation. A word is read left to right through the transition table: the longest
token with an arc from the present state is taken, and a shorter one where it leads nowhere.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwise.llm.common import attach, table, worker_cache

# Distinct words, with their marks, that a worker keeps with their ids before it starts anew.
CACHED_WORDS = 200_000
# Arcs looked up so far that a worker keeps.
TABLE_ARCS = 500_000
NEVER = 1 << 62
CONTROLS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte value of byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Automaton:
    """Merges compiled into a token automaton; ids are those of the vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], word_end: str = "") -> None:
        self.ids, self.word_end = vocabulary, word_end
        self.longest = max((len(t) for t in vocabulary), default=0)
        self.removed: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for time, (a, b) in enumerate(merges):
            self._gadget(time, a, b)
        self.table: dict[int, bool] = {}

    def _gadget(self, time: int, a: str, b: str) -> None:
        left, right, both = self.ids[a], self.ids[b], self.ids[a + b]
        self.removed.setdefault((left, right), time)
        self.parts.setdefault(both, (left, right, time))

    def _gone(self, state: int, token: int) -> int:
        """When the arc ``token`` left ``state`` or one of the states it was copied from."""
        until = NEVER
        while True:
            time = self.removed.get((state, token), NEVER)
            if time < until:
                return time
            if state not in self.parts:
                return NEVER
            _, state, copied = self.parts[state]
            until = min(until, copied)

    def _allowed(self, state: int, token: int) -> bool:
        """Whether the finished automaton has the arc: its left spine was there at each gadget."""
        needed = NEVER
        while True:
            gone = self._gone(state, token)
            if gone < needed or (gone == needed and needed < NEVER):
                return False
            if token not in self.parts:
                return True
            token, _, needed = self.parts[token]

    def arc(self, state: int, token: int) -> bool:
        key = state << 32 | token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= TABLE_ARCS:
                self.table.clear()
            found = self.table[key] = self._allowed(state, token)
        return found

    def encode(self, symbols: str) -> list[int]:
        """Ids of the accepted path over one word; its last symbol carries the word end.

        At each place the longest token whose arc exists is taken; where none leads on, the
        place is marked dead and the token before it is shortened. A place dies once at most.
        """
        n, get, arc, word_end = len(symbols), self.ids.get, self.arc, self.word_end
        path: list[int] = []
        ends: list[int] = []
        dead: set[int] = set()
        at, last, end = 0, -1, min(n, self.longest)
        while at < n:
            while end > at:
                token = get(symbols[at:end] + word_end if end == n else symbols[at:end])
                if token is not None and end not in dead and (last < 0 or arc(last, token)):
                    break
                end -= 1
            if end > at:
                path.append(token)
                ends.append(end)
                at, last, end = end, token, min(n, end + self.longest)
            elif not path:
                raise ValueError(f"no token path spells {symbols!r}")
            else:
                dead.add(at)
                path.pop()
                end = ends.pop() - 1
                at, last = (ends[-1], path[-1]) if path else (0, -1)
        return path


class Tokenizer:
    """A tokenizer file of the kind: NFC, lower case, pattern split, byte-level BPE with word ends."""

    def __init__(self, text: str) -> None:
        import regex

        spec = json.loads(text)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.split_special = (
            regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")").split
            if special
            else lambda t: [t]
        )
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0]["pattern"]["Regex"]).findall
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        missing = [s for s in self.symbols.values() for e in {"", self.automaton.word_end} if s + e not in model["vocab"]]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} byte symbols")
        self.cache: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        ids = []
        for word in self.words(chunk):
            ids += self.automaton.encode("".join(map(self.symbols.__getitem__, word.encode())))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            # Lower case letter by letter: no final-sigma rule.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # No word spans white space. str.split also splits at four controls that are no white space here.
        chunks = [text] if CONTROLS.search(text) else text.split()
        cache, out = self.cache, []
        for chunk in chunks:
            packed = cache.get(chunk)
            if packed is None:
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                packed = self._chunk(chunk)
                if len(chunk) <= 64:
                    cache[chunk] = packed
            out.append(packed)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        if "<" not in text or len(parts := self.split_special(text)) == 1:
            return b"".join(self._plain(text))
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out += self._plain(part)
        return b"".join(out)


class Labels:
    """The label of every arc of the automaton, by id; decoding needs nothing else."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        found = {i: t for t, i in spec["model"]["vocab"].items()}
        found |= {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        self.labels = [found.get(i) for i in range(max(found) + 1)]

    def decode(self, packed: bytes) -> str:
        """The labels on the arcs, joined as a vocabulary without a decoder joins them."""
        labels = map(self.labels.__getitem__, np.frombuffer(packed, dtype="<u4").tolist())
        return " ".join([label for label in labels if label is not None])


def _loader(path: str, kind: type) -> Callable[[], Tokenizer | Labels]:
    with open(path, encoding="utf-8") as file:
        text = file.read()

    def load() -> Tokenizer | Labels:
        cache, key = worker_cache(), (kind.__name__, hash(text))
        if key not in cache:
            cache[key] = kind(text)
        return cache[key]

    return load


def encode(df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``n_tokens`` and ``ids`` (packed little-endian unsigned 32-bit integers).

    ``tokenizer`` is the path of a tokenizer file on the driver; its text travels with the job.
    Null and empty texts have no tokens and empty ids; special tokens in a text count as
    such. Input columns named like the new ones are replaced; an empty table stays empty.
    """
    load = _loader(tokenizer, Tokenizer)

    def make():
        tokens = load()

        def run(texts: list[bytes]) -> list:
            ids = [tokens.encode(t.decode("utf-8", "replace")) for t in texts]
            return [[len(i) // 4 for i in ids], ids]

        return run

    return attach(df, text, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())], make, keep)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``decoded``, the labels of the packed ids; null ids decode to the empty text."""
    load = _loader(tokenizer, Labels)

    def make():
        labels = load()
        return lambda packed: [[labels.decode(p) for p in packed]]

    return attach(df, ids, [T.StructField("decoded", T.StringType())], make, keep)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    coded = encode(docs, tokenizer, keep=["doc_id"])
    return decode(coded, tokenizer, keep=["doc_id", "n_tokens", "ids"]).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every whole document encoded and decoded."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
