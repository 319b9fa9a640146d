"""BPE encoding by speculation: greedy longest match proposes, pairs of tokens are checked, failing words are merged exactly.

A word's greedy longest tokens are its BPE encoding if every token encodes to itself and no merge crosses the border of two neighbours.
A merge of rank q crosses if it joins a token x of the left one's right edge to a token y of the right one's left edge while both are whole: before
x and y are merged into larger ones themselves. Both edges are walked back from the whole tokens, always undoing the later merge, for all
different pairs of a batch at once in numpy. This needs merges in the order of their parts, one for each token, which is checked when the
tokenizer is read; without it all words are merged exactly. Words are greedily cut with an Aho-Corasick automaton of the vocabulary, and kept in a bounded table of each task.

Texts are normalised and cut into words as the tokenizer's file says: by its library, or, for the known rule with characters of Latin, Greek,
Cyrillic and general punctuation only, by an equal regular expression that is faster. Rows are encoded where they lie: no shuffle.

Defined cases: a null text counts as empty and has no tokens; special tokens in a text are taken as such; very long texts and words are read whole, in time that
grows as n log n; rows are independent, so ids may be null or repeat; columns with the names of results are replaced, others stay; an empty table gives an
empty result. In decoding, ids that the vocabulary lacks and null ids are left out, and null lists give null.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from tokenizers import Tokenizer

from pairforge.llm.tables import table
from pairforge.llm.words import small

NEVER = 1 << 40
#: Words that a task keeps with their tokens, none longer than WORD_CHARS; the table is emptied when full.
KEPT_WORDS, WORD_CHARS = 200_000, 64
ROWS = 128
#: Words of so many symbols or fewer are merged without a heap.
SHORT = 64
#: Marks words that the library has cut; no text holds a lone surrogate.
LIBRARY = "\ud800"

# The normaliser and word rule of the public word-end BPE files.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
KNOWN_WORDS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": KNOWN_SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SPACES = "\t-\r \x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f"
#: Characters of which all Unicode versions since 6 agree.
PLAIN = [*range(0x530), *range(0x2000, 0x2070)]


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in PLAIN if unicodedata.category(chr(c))[0] == kind)


def _byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte: itself where it is visible, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Bpe:
    """A tokenizer's file, ready for speculation. One a Python worker."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, self.library = spec["model"], Tokenizer.from_str(text)
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or spec.get("decoder"):
            raise ValueError("only plain BPE models without a decoder are supported")
        added = spec.get("added_tokens") or []
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError("added tokens must be plain special tokens")
        self.special = {a["content"]: a["id"] for a in added}
        self.cut = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        self.ends = model.get("end_of_word_suffix") or ""
        self.known = spec.get("normalizer") == KNOWN_NORMALIZER and spec.get("pre_tokenizer") == KNOWN_WORDS
        self.plain = re.compile("[\\x00-\u052f\u2000-\u206f]*")
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{SPACES}{_class('L')}{_class('N')}]+")
        self.letters = {b: c for b, c in _byte_letters().items() if chr(b) != c}
        self._read(model)
        self.kept: dict[str, list[int]] = {}

    def _read(self, model: dict) -> None:
        ids = {self._symbols(t): i for t, i in model["vocab"].items()}
        self.ids, self.size = ids, max(ids.values(), default=-1) + 1
        self.names: list[str | None] = [None] * max([self.size, *[i + 1 for i in self.special.values()]])
        for name, i in chain(model["vocab"].items(), self.special.items()):
            self.names[i] = name
        self.words = pa.array([n or "" for n in self.names], pa.string())
        self.left, self.right, self.rank = (np.full(self.size + 1, -1, np.int64) for _ in range(3))
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        self.ordered = True
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            x, y, z = ids[self._symbols(a)], ids[self._symbols(b)], ids[self._symbols(a + b)]
            # A part has to be a single symbol or made by an earlier merge, and each token is made by one merge.
            made = all(len(self._symbols(p)) == 1 or self.rank[i] >= 0 for p, i in ((a, x), (b, y)))
            self.ordered &= made and self.rank[z] < 0 and (x, y) not in self.ranks
            self.left[z], self.right[z], self.rank[z] = x, y, rank
            self.ranks.setdefault((x, y), rank)
            self.made.append(z)
        pairs = np.array([x * self.size + y for x, y in self.ranks], np.int64)
        order = pairs.argsort()
        self.pairs, self.pair_ranks = pairs[order], np.array(list(self.ranks.values()), np.int64)[order]
        made = np.flatnonzero(self.rank[:-1] >= 0)
        own = ~self.crossed(self.left[made], self.right[made], self.rank[made])
        # A token encodes to itself if its parts do and nothing crosses their border earlier.
        self.itself = np.zeros(self.size, bool)
        self.itself[[i for s, i in ids.items() if len(s) == 1]] = True
        for t, ok in sorted(zip(made.tolist(), own.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
            self.itself[t] = ok and self.itself[self.left[t]] and self.itself[self.right[t]]
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()

    def _symbols(self, token: str) -> str:
        """One character a symbol: the last one of a word, with the word's end, is another than the same inside."""
        return token[: -len(self.ends) - 1] + chr(0x10000 + ord(token[-len(self.ends) - 1])) if self.ends and token.endswith(self.ends) and len(token) > len(self.ends) else token

    def crossed(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether a merge of a rank below the limit crosses the border between them."""
        a, b, above_a, above_b = a.copy(), b.copy(), limit.copy(), limit.copy()
        out, live = np.zeros(len(a), bool), np.arange(len(a))
        while len(live) and len(self.pairs):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            q = np.where(self.pairs[at] == key, self.pair_ranks[at], NEVER)
            # Of equal merges the left one comes first, so x is gone by then and y is not.
            hit = (q < above_a[live]) & (q <= above_b[live]) & (q < limit[live])
            out[live[hit]] = True
            rx, ry = self.rank[x], self.rank[y]
            of_b, of_a = ~hit & (ry >= rx) & (ry >= 0), ~hit & (rx > ry)
            i, j = live[of_b], live[of_a]
            above_b[i], b[i] = ry[of_b], self.left[y[of_b]]
            above_a[j], a[j] = rx[of_a], self.right[x[of_a]]
            live = live[of_a | of_b]
        return out

    def merged(self, symbols: str) -> list[int]:
        """The exact encoding: the merge of the least rank first, of equal ones the leftmost."""
        ids = [self.ids[s] for s in symbols]
        return self._merged_short(ids) if len(ids) <= SHORT else self._merged_long(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        rank = self.ranks.get
        ranks = [rank(p, NEVER) for p in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """With a heap, for words in which looking at all pairs for each merge would take too long."""
        n, rank = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            least, i, x, y = heapq.heappop(queue)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = self.made[least], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (r := rank((ids[left], ids[after[left]]))) is not None:
                    heapq.heappush(queue, (r, left, ids[left], ids[after[left]]))
        return [t for t in ids if t >= 0]

    def speculated(self, words: list[str]) -> list[list[int]]:
        """The tokens of words that are given as symbols."""
        if not self.ordered or not words:
            return [self.merged(w) for w in words]
        out = [[t for _, t in self.automaton.iter_long(w)] for w in words]
        flat = np.fromiter(chain.from_iterable(out), np.int64)
        word = np.repeat(np.arange(len(out)), [len(x) for x in out])
        inside = word[1:] == word[:-1]
        pairs, which = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
        a, b = pairs // self.size, pairs % self.size
        fails = self.crossed(a, b, np.full(len(a), NEVER))
        again = set(word[1:][inside][fails[which]].tolist()) | set(word[~self.itself[flat]].tolist())
        for k in again:
            out[k] = self.merged(words[k])
        return out

    def words_of(self, text: str) -> list[str]:
        if self.known and self.plain.fullmatch(text):
            # The library lower-cases letter by letter, without a final form of sigma. White space is in no word, so it stays as it is.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if self.plain.fullmatch(text):
                return self.word.findall(text)
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        # Words of the library are in byte letters already; a mark in front tells them apart in the table of words.
        return [LIBRARY + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)] if text else []

    def _parts(self, text: str | None) -> list[list[str]]:
        """The words of a text; a special token is a part of its own."""
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return [self.words_of(text)]
        return [[p] if p in self.special else self.words_of(p) for p in self.cut.split(text) if p]

    def encoded(self, texts: list[str | None]) -> pa.ListArray:
        """The tokens of each text, as int32."""
        rows = [list(chain.from_iterable(ps)) if len(ps) > 1 else ps[0] if ps else [] for ps in map(self._parts, texts)]
        kept = self.kept
        kept.update({s: np.int32(i).tobytes() for s, i in self.special.items()})
        new = [w for w in set().union(*rows) if w not in kept]
        symbols = [self._symbols((w[1:] if w[0] == LIBRARY else w.encode().decode("latin1").translate(self.letters)) + self.ends) for w in new]
        made = self.speculated(symbols)
        flat = np.fromiter(chain.from_iterable(made), np.int32).tobytes()
        ends = np.cumsum([4 * len(x) for x in made]).tolist()
        kept.update((w, flat[a:b]) for w, a, b in zip(new, [0, *ends], ends))  # noqa: B905
        # Tokens are put together as bytes: a text's are those of its words, one after the other.
        found = [b"".join(map(kept.__getitem__, row)) for row in rows]
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
        for w in new:
            if len(w) > WORD_CHARS:
                del kept[w]
        if len(kept) > KEPT_WORDS:
            kept.clear()
        return pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(found), np.int32))

    def decoded(self, lists: pa.ListArray) -> pa.Array:
        """Tokens as they are written in the vocabulary, with a space between: what a file without a decoder asks for."""
        ids = lists.flatten()
        known = pc.fill_null(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(self.names))), False)
        if not pc.all(known).as_py():
            return pa.array([None if x is None else " ".join([self.names[i] for i in x if i is not None and 0 <= i < len(self.names) and self.names[i] is not None]) for x in lists.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        words = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), self.words.take(ids))
        return pc.if_else(pc.is_valid(lists), pc.binary_join(words, " "), None)


@lru_cache(maxsize=2)
def reader(text: str) -> Bpe:
    return Bpe(text)


def _added(df: DataFrame, read: str, name: str, kind, make) -> DataFrame:
    """df with the column `name`, made from `read` a batch at a time."""
    df = df.drop(*[c for c in df.columns if c.lower() == name and c != read])
    schema = StructType([f for f in df.schema.fields if f.name != name]).add(name, kind)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(rows, ROWS):
            made = make(batch.column(batch.schema.get_field_index(read)))
            names = [n for n in batch.schema.names if n != name]
            yield pa.record_batch([*[batch.column(batch.schema.get_field_index(n)) for n in names], made], names=[*names, name])

    return df.mapInArrow(batches, schema)


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs with ids: array<int>, the tokens of text. tokenizer: a BPE file of the tokenizers library, read by the driver and sent to the tasks (a vocabulary, some 2 MB)."""
    spec = docs.sparkSession.sparkContext.broadcast(_contents(tokenizer))
    return _added(docs, text, "ids", ArrayType(IntegerType()), lambda texts: reader(spec.value).encoded(texts.to_pylist()))


def decode(docs: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """docs with decoded: the text that the tokenizer's file gives for the ids."""
    spec = docs.sparkSession.sparkContext.broadcast(_contents(tokenizer))
    return _added(docs, ids, "decoded", StringType(), lambda lists: reader(spec.value).decoded(lists))


def _contents(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def op11_speculative_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer).drop("text")
    hashed = docs.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)})
    return decode(hashed, tokenizer).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
