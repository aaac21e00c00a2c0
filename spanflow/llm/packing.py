"""Packing of documents into token windows by lexical retrieval.

Documents become ids of a byte-level BPE vocabulary, each with an end id. Full windows of a long document stand by
themselves; what is left of each document is packed: a seed's window is filled by those unused documents of its shard
that a BM25 inverted index ranks highest for the seed, the last of them cut where the window is full, its rest being
the next seed. Document frequencies and the mean length are counted over all documents; a shard is a bounded block of
rows that resemble each other, and the window that is open at the end of a shard goes on in the next.

Which rows make a shard is decided by content, not by their place in the table: a row's key is a weighted sample of its
terms (of all terms the ones with the smallest exponential draws, which depend on the term alone, at a rate that grows
with rarity), so that two rows are the likelier to share terms of the key the more rare terms they share. Rows are dealt
into partitions and sorted by key; a key that many rows have is split by a hash of the id.

Ids are computed once and kept in the shared folder as 16-bit numbers. Sequence numbers hold the partition and a count.

Defined cases: a null text counts as empty, which is a document of the end id alone; rows with null or repeated doc_id
are packed like others, each row by itself; ties of scores go to the earlier row; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, codes, discard, materialise, span_hashes

WINDOW, END, SHARD, K1, B = 1024, 0, 512, 1.2, 0.75
KEY_TERMS, KEY_SHARE = 4, 0.005
CACHE = 1_500_000
#: Fixed values of the vocabulary.
MARKER, MARKER_ID = "<|endoftext|>", 50256


class Encoder:
    """Ids of many texts at once. Texts are split into the pieces of the vocabulary's pattern with array operations,
    each distinct piece is looked up once; texts with letters beyond Latin or with apostrophes take the library's way."""

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()
        kind = np.zeros(0x250, np.uint8)  # 0 other, 1 letter, 2 number, 3 blank
        for x in range(len(kind)):
            c = chr(x)
            kind[x] = 1 if c.isalpha() else 2 if c.isnumeric() else 3 if c.isspace() and not 0x1C <= x <= 0x1F else 0
        self.kind = kind

    def _forget(self) -> None:
        """The known pieces: their hashes in order, and where their ids lie."""
        self.hash, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a marker of the vocabulary that stands in one is the marker's id, as in its tokenizer."""
        marked = [i for i, x in enumerate(texts) if MARKER in x]
        if not marked:
            return self._texts(texts)
        parts = [x.split(MARKER) for x in texts]
        flat = iter(self._texts([p for x in parts for p in x]))
        out = []
        for x in parts:
            own = [next(flat)]
            for _ in x[1:]:
                own += [np.array([MARKER_ID], np.uint16), next(flat)]
            out.append(np.concatenate(own))
        return out

    def _texts(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        easy = [i for i, x in enumerate(texts) if "'" not in x and (x.isascii() or len(x.encode("utf-8")) < 2 * len(x) and max(set(x)) < "\u0250")]
        for i in {*range(len(texts))}.difference(easy):
            out[i] = np.array(self.bpe.encode_ordinary(texts[i]), np.uint16)
        chosen = [texts[i] for i in easy]
        for a, b in batches(chosen, 1 << 22):
            for i, ids in zip(easy[a:b], self._encode(chosen[a:b]), strict=True):
                out[i] = ids
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        code, ends = codes(texts)
        if not len(code):
            return [np.zeros(0, np.uint16)] * len(texts)
        kind = self.kind[code]
        begins = np.ones(len(code), bool)
        begins[1:] = kind[1:] != kind[:-1]
        starts = np.zeros(len(code), bool)
        starts[ends[:-1][ends[:-1] < len(code)]] = True
        begins |= starts
        # the last blank of a run goes with what follows if it is a space, and else stands alone
        after = np.flatnonzero((kind[1:] != 3) & (kind[:-1] == 3) & ~starts[1:]) + 1
        begins[after - 1] = True
        begins[after] = code[after - 1] != 32
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(code))
        hashes, first, piece = np.unique(span_hashes(code, start, end), return_index=True, return_inverse=True)
        if len(self.hash) > CACHE:
            self._forget()
        place = np.searchsorted(self.hash, hashes)
        new = np.flatnonzero(self.hash[np.minimum(place, len(self.hash) - 1)] != hashes) if len(self.hash) else np.arange(len(hashes))
        if len(new):
            single = self.bpe._encode_single_piece
            made = [single(whole[s:e]) for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            begin = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate((self.ids, np.array([i for x in made for i in x], np.uint16)))
            spot = place[new]
            self.hash, self.at, self.size = np.insert(self.hash, spot, hashes[new]), np.insert(self.at, spot, begin), np.insert(self.size, spot, sizes)
            place = np.searchsorted(self.hash, hashes)
        ids, offset, lengths = self.ids, self.at[place], self.size[place]
        n = lengths[piece]
        after = np.cumsum(n)
        flat = ids[np.repeat(offset[piece] - (after - n), n) + np.arange(int(after[-1]))]
        cut = np.concatenate(([0], after))[np.searchsorted(start, ends)]
        return [flat[a:b] for a, b in zip(cut, cut[1:], strict=False)]


_encoder: dict = {}


def encoder(vocabulary: str | None) -> Encoder:
    """One encoder a worker process."""
    if vocabulary not in _encoder:
        _encoder[vocabulary] = Encoder(vocabulary)
    return _encoder[vocabulary]


def token_ids(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian 16-bit numbers, the end id last) of every row."""

    def run(frames):
        for pdf in frames:
            ids = encoder(vocabulary).encode(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [np.append(x, np.uint16(END)).astype("<u2").tobytes() for x in ids]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"doc_id {kind}, ids binary")


def term_counts(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """In how many documents each id occurs, the number of documents, their mean length. At most 65,536 numbers."""

    def run(frames):
        df, docs, total = np.zeros(1 << 16, np.int64), 0, 0
        for pdf in frames:
            docs += len(pdf)
            for raw in pdf["ids"]:
                ids = np.frombuffer(raw, "<u2")
                total += len(ids)
                seen = np.zeros(1 << 16, bool)
                seen[ids] = True
                df[np.flatnonzero(seen)] += 1
        term = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(term, [-1, -2]), "n": np.append(df[term], [docs, total])})

    counted = dict(tokens.select("ids").mapInPandas(run, "term int, n bigint").groupBy("term").agg(F.sum("n")).collect())
    df = np.zeros(1 << 16, np.int64)
    for term, n in counted.items():
        if term >= 0:
            df[term] = n
    docs = counted.get(-1) or 0
    return df, docs, (counted.get(-2) or 0) / max(1, docs)


def draws(df: np.ndarray, docs: int, seed: int = 7) -> np.ndarray:
    """A draw for each id: exponential, at the rate of its squared weight; infinite for ids that fewer than `KEY_SHARE` of all
    documents have, or only one, or over half."""
    weight = np.where(df >= max(2, KEY_SHARE * docs), np.maximum(0, np.log((docs - df + 0.5) / (df + 0.5))) ** 2, 0)
    u = np.random.default_rng(seed).random(len(df))
    return np.where(weight > 0, -np.log(u) / np.maximum(weight, 1e-9), np.inf)


def content_key(ids: np.ndarray, draw: np.ndarray) -> int:
    """The terms of the smallest draws, the smallest first, as one number of 16 bits a term."""
    term = np.unique(ids)
    mine = draw[term]
    few = np.argpartition(mine, KEY_TERMS)[:KEY_TERMS] if len(term) > KEY_TERMS else np.arange(len(term))
    few = few[np.argsort(mine[few], kind="stable")]
    key = 0
    for i in few[np.isfinite(mine[few])].tolist():
        key = key << 16 | int(term[i])
    return (key << 16 * (KEY_TERMS - int(np.isfinite(mine[few]).sum()))) - (1 << 63)


def by_content(tokens: DataFrame, df: np.ndarray, n: int) -> DataFrame:
    """tokens, a written table that is deleted then, dealt into partitions and sorted so that rows of similar content are neighbours."""
    shipped = tokens.sparkSession.sparkContext.broadcast(draws(df, n))

    def run(frames):
        for pdf in frames:
            yield pdf.assign(key=[content_key(np.frombuffer(raw, "<u2"), shipped.value) for raw in pdf["ids"]])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    keyed = tokens.mapInPandas(run, f"doc_id {kind}, ids binary, key bigint").withColumn("luck", F.xxhash64("doc_id"))
    keyed = materialise(keyed)  # the ranges are then found from two columns of a written table
    discard(tokens)
    return keyed.repartitionByRange("key", "luck").sortWithinPartitions("key", "luck", F.xxhash64("ids")).select("doc_id", "ids")


class Shard:
    """BM25 inverted index of a block of documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.terms, rows, weights = [], [], []
        for i, ids in enumerate(docs):
            tf = np.bincount(ids)
            term = np.flatnonzero(tf)
            term = term[idf[term] > 0]
            n = tf[term]
            self.terms.append(term)
            rows.append(np.full(len(term), i, np.int32))
            weights.append((idf[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ids) / max(mean, 1)))).astype(np.float32))
        term, row, weight = (np.concatenate(x) for x in (self.terms, rows, weights))
        order = np.argsort(term, kind="stable")
        self.row, self.weight = row[order], weight[order]
        self.at = np.zeros((1 << 16) + 1, np.int64)
        np.cumsum(np.bincount(term, minlength=1 << 16), out=self.at[1:])
        self.size = len(docs)

    def scores(self, query: int) -> np.ndarray:
        """BM25 of all documents of the shard for the query document's distinct terms."""
        term = self.terms[query]
        first, n = self.at[term], self.at[term + 1] - self.at[term]
        total = np.cumsum(n)
        if not len(total) or not total[-1]:
            return np.zeros(self.size)
        posting = np.repeat(first - (total - n), n) + np.arange(int(total[-1]))
        return np.bincount(self.row[posting], self.weight[posting], minlength=self.size)


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset of every piece."""
    tokens = materialise(token_ids(docs, vocabulary))
    df, n, mean = term_counts(tokens)
    idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5))).astype(np.float32)  # terms in over half of all documents tell nothing
    shipped = docs.sparkSession.sparkContext.broadcast((idf, mean))

    def run(frames):
        idf, mean = shipped.value
        count = TaskContext.get().partitionId() << 32
        open_, used = -1, window  # the sequence that is being filled, and its tokens so far

        def shards():
            held: list = []
            for pdf in frames:
                held += zip(pdf["doc_id"], pdf["ids"], strict=True)
                while len(held) >= SHARD:
                    yield held[:SHARD]
                    held = held[SHARD:]
            if held:
                yield held

        for held in shards():
            docs = [np.frombuffer(raw, "<u2") for _, raw in held]
            out: list[tuple] = []
            for i, ids in enumerate(docs):
                for a in range(0, len(ids) - window + 1, window):
                    out.append((i, a, window, count, 0))
                    count += 1
            index = Shard(docs, idf, mean)
            start = [len(x) - len(x) % window for x in docs]
            free = np.array([len(x) % window > 0 for x in docs])
            seed = None
            while free.any():
                if seed is None:  # the earliest unused document opens a window, or goes on in the one left open by the last shard
                    ranked = [int(free.argmax())]
                else:
                    score = index.scores(seed)
                    score[~free] = -1
                    ranked = np.argsort(-score, kind="stable")[: int(free.sum())].tolist()
                for i in ranked:
                    if used == window:
                        open_, used, count = count, 0, count + 1
                        seed = i
                    rest = len(docs[i]) - start[i]
                    n = min(rest, window - used)
                    out.append((i, start[i], n, open_, used))
                    start[i] += n
                    used += n
                    free[i] = False
                    seed = i if seed is None else seed
                    if n < rest:  # cut where the window is full; the rest opens the next one and is its seed
                        open_, used, count = count, rest - n, count + 1
                        out.append((i, start[i], rest - n, open_, 0))
                        seed = i
                        break
                    if used == window:
                        seed = None
                        break
            yield _frame(held, docs, out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_content(tokens, df, n).mapInPandas(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def _frame(held: list, docs: list[np.ndarray], out: list[tuple]) -> pd.DataFrame:
    wide = [x.astype("<u4") for x in docs]
    return pd.DataFrame({
        "doc_id": [held[i][0] for i, *_ in out], "start": [x[1] for x in out], "length": [x[2] for x in out], "ids": [wide[x[0]][x[1] : x[1] + x[2]].tobytes() for x in out],
        "doc_tokens": [len(docs[x[0]]) for x in out], "sequence_id": [x[3] for x in out], "offset": [x[4] for x in out],
    })
