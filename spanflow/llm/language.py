"""Language identification by cross-parsing entropy.

For each language a suffix automaton of its labelled text is built. A text is parsed greedily into the longest
phrases that occur in that language's text; the language that needs the fewest phrases for the text's length wins.
The alphabet is every letter of the labelled texts. Steps by the commonest letters are kept in one dense table in which
a step that would leave the automaton starts the next phrase, so many blocks of many texts are parsed in step with each
other; steps by the other letters, of which large scripts have thousands, are looked up in a hash table.

Texts are lower-cased, every run of other characters than letters becomes one blank, and parsing starts anew every
`BLOCK` characters, for all languages alike, so that a very long text is many short jobs.

Defined cases: a null text, or one without a letter, gets `und` and score 0; on a tie the smallest language name
wins; if there is nothing to learn from, every text is `und`; null or repeated ids, and other columns, don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, codes, held_out, sample_each

BLOCK, DENSE, TABLE_BYTES = 512, 63, 1 << 28
_BREAK = np.int32(1 << 30)


def _plain(text: str) -> str:
    """Lower-case letters and single blanks."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of `text`: for each state, symbol -> state."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new, p = len(step), last
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class _Steps:
    """Steps by rarer letters: an open hash table from state and symbol to state."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):  # those that find a free place of their own settle there, the others go one on
            spot = at[left]
            free = self.key[spot] < 0
            _, first = np.unique(spot[free], return_index=True)
            settled = left[np.flatnonzero(free)[first]]
            self.key[at[settled]], self.value[at[settled]] = keys[settled], values[settled]
            left = np.setdiff1d(left, settled)
            at[left] = (at[left] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The states, -1 where there is no such step."""
        out, at, left = np.full(len(keys), -1, np.int32), self._place(keys), np.arange(len(keys))
        while len(left):
            held = self.key[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.value[at[left[hit]]]
            left = left[~hit & (held >= 0)]
            at[left] = (at[left] + 1) & self.mask
        return out


class CrossParser:
    """One parsing table a language over a common alphabet: 0 is the blank, then come letters by how common they are."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        plain = {k: _plain(samples[k]) for k in self.languages}
        common = sorted(Counter("".join(plain.values()).replace(" ", "")).items(), key=lambda x: (-x[1], x[0]))
        self.letters = {c: i + 1 for i, (c, _) in enumerate(common)}
        self.unknown = len(self.letters) + 1  # a letter that no language has is a phrase of its own
        built = [suffix_automaton([0 if c == " " else self.letters[c] for c in plain[k]]) for k in self.languages]
        states = sum(map(len, built))
        self.dense = int(max(1, min(DENSE, self.unknown, TABLE_BYTES // (4 * max(1, states)) - 1)))  # so that many languages fit too
        self.tables, self.roots, self.rarer = [], [], []
        for steps in built:
            at, sym, to = (np.array(x, np.int64) for x in zip(*((i, c, j) for i, d in enumerate(steps) for c, j in d.items())))
            root = np.zeros(self.unknown + 1, np.int32)
            root[sym[at == 0]] = to[at == 0]
            root |= _BREAK  # every step from state 0 starts a phrase; a symbol that the language never had leads back there
            table = np.repeat(root[None, : self.dense], len(steps), 0)
            low = (sym < self.dense) & (at > 0)
            table[at[low], sym[low]] = to[low]
            high = (sym >= self.dense) & (at > 0)
            self.tables.append(table.ravel())
            self.roots.append(root)
            self.rarer.append(_Steps(at[high] * (self.unknown + 1) + sym[high], to[high].astype(np.int32)))
        self._symbol = None

    def _symbols(self, code: np.ndarray) -> np.ndarray:
        """Symbol of each code point, 0 for what is no letter."""
        if self._symbol is None:
            self._symbol = np.full(0x110000, -1, np.int32)
        seen = np.unique(code)
        for x in seen[self._symbol[seen] < 0].tolist():
            c = chr(x)
            self._symbol[x] = self.letters.get(c.lower()[:1], self.unknown) if c.isalpha() else 0
        return self._symbol[code]

    def _step(self, k: int, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after one symbol each, marked where a phrase starts with it."""
        if self.dense > self.unknown - 1 and not (symbol >= self.dense).any():
            return self.tables[k][state * self.dense + symbol]
        rare = np.flatnonzero(symbol >= self.dense)
        after = self.tables[k][state * self.dense + np.minimum(symbol, self.dense - 1)]
        if len(rare):
            s, c = state[rare].astype(np.int64), symbol[rare].astype(np.int64)
            found = self.rarer[k].find(s * (self.unknown + 1) + c)
            after[rare] = np.where(found >= 0, found, self.roots[k][c])
        return after

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases a text (rows) and language (columns) needs, and the text's letters and blanks."""
        count, size = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), np.int64)
        for a, b in batches(texts, 1 << 22):
            code, ends = codes(texts[a:b])
            symbol = self._symbols(code)
            first = np.zeros(len(symbol), bool)
            first[ends[:-1][ends[:-1] < len(symbol)]] = True
            blank = symbol == 0
            before = np.concatenate(([True], blank[:-1])) | first
            keep = ~(blank & before)  # no blank at the start, and one for a run
            total = np.concatenate(([0], np.cumsum(keep)))
            n = total[ends[1:]] - total[ends[:-1]]
            symbol = symbol[keep]
            size[a:b] = n
            blocks = -(-n // BLOCK)
            doc = np.repeat(np.arange(b - a), blocks)
            if not len(doc):
                continue
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            start = total[ends[:-1]][doc] + nth * BLOCK
            length = np.minimum(BLOCK, n[doc] - nth * BLOCK)
            order = np.argsort(-length, kind="stable")
            start, length = start[order], length[order]
            lanes = np.searchsorted(-length, -np.arange(1, BLOCK + 1), "right")  # blocks that have a t-th symbol
            for k in range(len(self.languages)):
                state, breaks = np.zeros(len(doc), np.int32), np.zeros(len(doc), np.int32)
                for t in range(int(length[0])):
                    m = lanes[t]
                    after = self._step(k, state[:m], symbol[start[:m] + t])
                    breaks[:m] += after >> 30
                    np.bitwise_and(after, _BREAK - 1, out=state[:m])
                count[a:b, k] += np.bincount(doc[order], breaks, minlength=b - a).astype(np.int64)
        return count, size

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score; the score is the winner's share when each phrase more halves a language's weight."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        count, size = self.phrases(texts)
        best = count.argmin(1)
        share = 1 / np.exp2(-np.minimum(60.0, count - count.min(1, keepdims=True))).sum(1)
        none = size == 0
        return ["und" if none[i] else self.languages[best[i]] for i in range(len(texts))], np.where(none, 0.0, share)


def train_language(docs: DataFrame, chars: int = 20_000, rows: int = 60, max_languages: int = 1000) -> CrossParser:
    """Learns from `chars` characters of at most `rows` labelled texts a language, outside the held-out fold: of each text
    about as much, from a place that a hash of its id gives. More languages than `max_languages` are an error."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out())
    texts: dict[str, list[tuple]] = {}
    for doc, lang, text in sample_each(docs, known.select("doc_id", "lang"), "lang", rows, max_languages):
        texts.setdefault(lang, []).append((len(text), zlib.crc32(str(doc).encode()), text))
    samples = {}
    for lang, rows_ in texts.items():
        parts, left = [], chars
        for k, (size, luck, text) in enumerate(sorted(rows_)):  # short texts first, so that longer ones make up for them
            n = min(size, -(-left // (len(rows_) - k)))
            at = luck % (size - n + 1)
            parts.append((luck, text[at : at + n]))
            left -= n
        samples[lang] = " ".join(x for _, x in sorted(parts))
    return CrossParser({k: v for k, v in samples.items() if any(c.isalpha() for c in v)})


def identify_language(docs: DataFrame, model: CrossParser) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for pdf in frames:
            lang, score = shipped.value.predict(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": lang, "score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
