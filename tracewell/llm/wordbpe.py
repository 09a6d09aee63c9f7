"""Word-level BPE with word ends: splitting, encoding and decoding of whole texts.

The tokenizer file names the rules: NFC, lower case, a split into contractions, letter
runs, single numbers and runs of other signs; byte-level symbols; the last symbol of a
word carries the word end. Words repeat, so every distinct word of a chunk is resolved
once and texts are put together from word codes with numpy. Latin text is split here;
of any other sign the library's own tables decide the class, as Unicode versions differ.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain, islice

import numpy as np

WORD_END = "</w>"
NO_MERGE = 1 << 40
#: The file's split, for lower-case text made of ASCII and the Latin letters below U+0180. They must equal the file's.
LATIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\t-\r 0-9a-zß-öø-ſ]+")
LATIN_UNITS = re.compile(r"\n|" + LATIN_SPLIT.pattern)
BEYOND_LATIN = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-įĲ-ſ]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where visible, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of one tokenizer file as arrays.

    left, right: the two parts of a merged token, -1 for single symbols.
    rank: position in the merge list, -1 for single symbols; parts rank lower.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        n = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings = [""] * n
        for token, k in [*self.ids.items(), *self.special.items()]:
            self.strings[k] = token
        self.left, self.right, self.rank = (np.full(n, -1, np.int64) for _ in range(3))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[x, y] = (r, z)
            self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.array([(x << 32) | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks, self.pair_tokens = np.array([*self.merges.values()], np.int64)[order].T.copy()
        symbols = byte_symbols()
        self.symbols = symbols
        self.translation = str.maketrans({chr(b): s for b, s in enumerate(symbols)})
        #: Longest token by its first two symbols.
        self.reach: dict[str, int] = {}
        for token in self.ids:
            self.reach[token[:2]] = max(len(token), self.reach.get(token[:2], 1))
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel units
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii() or BEYOND_LATIN.search(text) is None:
            return LATIN_SPLIT.findall(text.lower())
        text = self.normalize(text)
        return [text[a:b] for _, (a, b) in self.split(text)]

    def spelled(self, word: str) -> str:
        """The word in byte symbols, with its word end."""
        return (word if word.isascii() and word.isalnum() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.translation)) + WORD_END

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and token of merging a with b; NO_MERGE and -1 where no merge exists."""
        keys = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == keys) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_ranks[at], NO_MERGE), np.where(hit, self.pair_tokens[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pieces(text: str, vocab: Vocabulary) -> list[str]:
    """The words of one text; special tokens in it stand as they are."""
    if vocab.pattern is not None and "<|" in text and vocab.pattern.search(text):
        out, at = [], 0
        for m in vocab.pattern.finditer(text):
            out += vocab.words(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + vocab.words(text[at:])
    return vocab.words(text)


def merged(symbols: list[int], vocab: Vocabulary) -> list[int]:
    """Exact merging of one word: the lowest rank first, the leftmost among equals.

    A heap of candidate pairs over a linked list, so that a word of any length takes
    n log n steps; entries whose symbols have changed meanwhile are passed over.
    """
    merges = vocab.merges
    after = [*range(1, len(symbols)), -1]
    before = [*range(-1, len(symbols) - 1)]
    symbols = list(symbols)
    heap = [(*merges[p], k, p) for k, p in enumerate(zip(symbols, symbols[1:])) if p in merges]
    heapq.heapify(heap)
    while heap:
        _, whole, k, (a, b) = heapq.heappop(heap)
        other = after[k]
        if symbols[k] != a or other < 0 or symbols[other] != b:
            continue
        symbols[k], symbols[other] = whole, -1
        after[k] = after[other]
        if after[k] >= 0:
            before[after[k]] = k
            if (p := (whole, symbols[after[k]])) in merges:
                heapq.heappush(heap, (*merges[p], k, p))
        if before[k] >= 0 and (p := (symbols[before[k]], whole)) in merges:
            heapq.heappush(heap, (*merges[p], before[k], p))
    return [x for x in symbols if x >= 0]


def merged_together(words: list[list[int]], vocab: Vocabulary) -> list[list[int]]:
    """Exact merging of many words of like length: one merge in every word per step."""
    n, width = len(words), max(map(len, words))
    sizes = np.fromiter(map(len, words), np.int64, n)
    grid = np.full((n, width), -1, np.int64)
    grid[np.arange(width) < sizes[:, None]] = np.fromiter((x for w in words for x in w), np.int64, int(sizes.sum()))
    far = NO_MERGE
    rank, whole = vocab.pair(grid[:, :-1].ravel(), grid[:, 1:].ravel())
    rank, whole = rank.reshape(n, width - 1), whole.reshape(n, width - 1)
    live = np.arange(n)
    columns = np.arange(width)
    while len(live):
        at = rank[live].argmin(1)
        go = rank[live, at] < far
        live, at = live[go], at[go]
        if not len(live):
            break
        grid[live, at] = whole[live, at]
        # Close the gap at at + 1: later symbols and their pairs move one to the left.
        take = np.minimum(columns + (columns > at[:, None]), width - 1)
        rows = np.take_along_axis(grid[live], take, 1)
        rows[:, -1] = -1
        grid[live] = rows
        take = take[:, :-1]
        for table, none in ((rank, far), (whole, -1)):
            moved = np.take_along_axis(table[live], np.minimum(take, width - 2), 1)
            moved[:, -1] = none
            table[live] = moved
        for k, part in ((at - 1, at > 0), (at, at < width - 1)):
            rows, k = live[part], k[part]
            rank[rows, k], whole[rows, k] = vocab.pair(grid[rows, k], grid[rows, k + 1])
    return [row[: row.index(-1)] if -1 in row else row for row in grid.tolist()]


class SpeculativeEncoder:
    """Speculate and verify.

    Greedy longest match proposes tokens. A proposal is the BPE result exactly when every
    adjacent pair is compatible: no merge across the seam would have run before the parts
    at the seam were swallowed by their own tokens. Pairs are tested together as arrays and
    remembered; words with a failing pair are merged exactly.
    """

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.known: dict[int, bool] = {}
        self.exact_words = 0
        self.words = 0

    def propose(self, spelled: str) -> list[int]:
        get, reach = self.vocab.ids.get, self.vocab.reach.get
        end = len(spelled)
        last = end - len(WORD_END) - 1
        out, at = [], 0
        while True:
            # Either the whole rest with the word end, or some of the body without it.
            stop = at + reach(spelled[at : at + 2], 1)
            if stop >= end and (k := get(spelled[at:])) is not None:
                out.append(k)
                return out
            if stop > last:
                stop = last
            while (k := get(spelled[at:stop])) is None:
                stop -= 1
                if stop <= at:
                    raise ValueError(f"no token for {spelled[at:]!r}")
            out.append(k)
            at = stop

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b may stand side by side, for arrays of pairs.

        Walks down the right edge of a and the left edge of b, from the latest parts to the
        earliest, through all parts that touch the seam at one time. A merge across the seam
        runs if its rank is below that of the merge that swallows the left part and not
        above that of the right part (equal ranks go from left to right).
        """
        v = self.vocab
        x, y = a.copy(), b.copy()
        far = 1 << 39
        until_x, until_y = np.full(len(a), far), np.full(len(a), far)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            xs, ys = x[live], y[live]
            r, _ = v.pair(xs, ys)
            bad = (r < until_x[live]) & (r <= until_y[live])
            good[live[bad]] = False
            rx, ry = v.rank[xs], v.rank[ys]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            down_x = go & (rx > ry)
            down_y = go & ~down_x
            k = live[down_x]
            until_x[k], x[k] = rx[down_x], v.right[xs[down_x]]
            k = live[down_y]
            until_y[k], y[k] = ry[down_y], v.left[ys[down_y]]
            live = live[go]
        return good

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the words in a row, and how many each word has."""
        v = self.vocab
        special = v.special
        spelled = [v.spelled(w) for w in words]
        out = [[special[w]] if w in special else self.propose(s) for w, s in zip(words, spelled)]
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for ids in out for t in ids), np.int64, int(lengths.sum()))
        if len(flat) < 2:
            return flat, lengths
        owner = np.repeat(np.arange(len(out)), lengths)
        inner = owner[1:] == owner[:-1]
        a, b, owner = flat[:-1][inner], flat[1:][inner], owner[1:][inner]
        keys, where = np.unique((a << 32) | b, return_inverse=True)
        known = self.known
        verdict = np.array([known.get(k, 2) for k in keys.tolist()], np.int8)
        new = np.flatnonzero(verdict == 2)
        if len(new):
            if len(known) > 1_000_000:
                known.clear()
            fresh = self.compatible(keys[new] >> 32, keys[new] & 0xFFFFFFFF)
            verdict[new] = fresh
            known.update(zip(keys[new].tolist(), fresh.tolist()))
        failing = np.unique(owner[verdict[where] == 0])
        single = v.ids
        todo = sorted(failing.tolist(), key=lambda k: len(spelled[k]))
        for few in (todo[i : i + 2000] for i in range(0, len(todo), 2000)):
            bodies = [spelled[k][: -len(WORD_END)] for k in few]
            symbols = [[*map(single.__getitem__, x[:-1]), single[x[-1] + WORD_END]] for x in bodies]
            together = [k for k, x in enumerate(symbols) if len(x) <= 64]
            if together:
                for k, x in zip(together, merged_together([symbols[k] for k in together], v)):
                    out[few[k]] = x
            for k in range(len(together), len(few)):
                out[few[k]] = merged(symbols[k], v)
        self.words += len(words)
        self.exact_words += len(failing)
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int64, int(lengths.sum())), lengths


class LibraryEncoder:
    """Distinct words through the tokenizers library.

    The words are normalised and split already, so the library gets the file's model
    with a split at spaces alone, and many words in one call; the word end tells where
    each word's tokens stop.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.vocab = vocabulary(path)
        loaded = Tokenizer.from_file(path)
        self.library = Tokenizer(loaded.model)
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.array([x.endswith(WORD_END) for x in self.vocab.strings])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the words in a row, and how many each word has."""
        special = self.vocab.special
        if any(w in special for w in words):
            single = [self.encode([w]) if w not in special else (np.array([special[w]]), np.ones(1, np.int64)) for w in words]
            return np.concatenate([x for x, _ in single]), np.concatenate([n for _, n in single])
        texts = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
        runs = [np.zeros(0, np.int64)]
        for k in range(0, len(texts), 16):  # the library's results are large, so few at a time
            runs += [np.array(x.ids, np.int64) for x in self.library.encode_batch_fast(texts[k : k + 16], add_special_tokens=False)]
        flat = np.concatenate(runs)
        stops = np.flatnonzero(self.ends[flat]) + 1
        if len(stops) != len(words):
            raise ValueError("word ends and words disagree")
        return flat, np.diff(stops, prepend=0)


def gathered(values: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[starts[r]:starts[r + 1]] of all rows one after another, and their bounds."""
    lengths = starts[rows + 1] - starts[rows]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    take = np.arange(bounds[-1]) + np.repeat(starts[rows] - bounds[:-1], lengths)
    return values[take], bounds


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class Codes:
    """Texts as numbered units (runs without ASCII white space), each resolved once.

    The table of units starts anew at a chunk's begin once it holds most_units: it only
    saves work, so that changes no result and bounds memory.
    """

    def __init__(self, encoder, most_units: int = 300_000, decode: bool = False):
        self.encoder, self.most_units, self.decode = encoder, most_units, decode
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.shown: list[bytes] = []
        self.some_empty = False
        self.tokens = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _learn(self) -> None:
        known = len(self.starts) - 1
        units = list(islice(self.numbers, known, None))
        if not units:
            return
        vocab = self.encoder.vocab
        words = _Numbers()
        words["\n"] = 0
        joined = b"\n".join(units).decode("utf-8", "surrogatepass") + "\n"
        if "<|" not in joined and BEYOND_LATIN.search(joined) is None:
            parts = LATIN_UNITS.findall(joined.lower())
        else:
            parts = [w for u in joined.split("\n")[:-1] for w in (*pieces(u, vocab), "\n")]
        coded = np.fromiter(map(words.__getitem__, parts), np.int64, len(parts))
        stops = np.flatnonzero(coded == 0)
        counts = np.diff(stops, prepend=-1) - 1
        coded = coded[coded > 0] - 1
        names = list(islice(words, 1, None))
        flat, lengths = self.encoder.encode(names)
        tokens, bounds = gathered(flat, np.concatenate([[0], np.cumsum(lengths)]), coded)
        cuts = bounds[np.concatenate([[0], np.cumsum(counts)])]
        self.tokens = np.concatenate([self.tokens, tokens.astype(np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + cuts[1:]])
        self.some_empty |= bool((counts == 0).any())
        if self.decode:
            strings = list(map(vocab.strings.__getitem__, tokens.tolist()))
            cuts = cuts.tolist()
            self.shown += [" ".join(strings[a:b]).encode("utf-8", "surrogatepass") for a, b in zip(cuts, cuts[1:])]

    def ids(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes] | None]:
        """Token ids of each text (UTF-8), and the decoded texts in UTF-8 if asked for."""
        if len(self.numbers) > self.most_units:
            self._clear()
        split = [x.split() for x in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        self._learn()
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        decoded = None
        if self.decode:
            shown = self.shown.__getitem__
            parts = (map(shown, flat[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:]))
            decoded = [b" ".join(filter(None, x) if self.some_empty else x) for x in parts]
        tokens, bounds = gathered(self.tokens, self.starts, flat)
        bounds = bounds[cuts]
        return [tokens[a:b] for a, b in zip(bounds[:-1], bounds[1:])], decoded


def decoder_of(vocab: Vocabulary) -> Callable[[Iterable[int]], str]:
    """Decoding without a decoder rule: token strings joined by spaces."""
    return lambda ids: " ".join(vocab.strings[k] for k in ids if k < len(vocab.strings))
