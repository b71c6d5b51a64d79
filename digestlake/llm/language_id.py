"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The score of a word is the sum, over all
ways to cut it into pieces, of the products of their probabilities; a forward pass over the characters gets that sum
without listing the cuts, for all languages and all new words of a batch at once. Long words are passed in many blocks
side by side: a block's pass from each state that it can begin in makes a small matrix, and the matrices are multiplied
in order. The score of a text is the sum of its words' logarithms and the language's prior. Words are runs of letters
in lower case. Workers remember words, up to a bound in bytes.

Training reads a bounded sample of the labelled documents (TRAIN_DOCS for each language). Piece probabilities start
from one segmentation per word and are then fitted to expected counts over all segmentations. The model is a table of
vocabulary size times number of languages, which is all that is sent to the executors; MODEL_BYTES bounds it, and more
languages than fit raise an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from digestlake.llm.common import prepared, quoted, released, slices, written
from digestlake.llm.token_counts import forget_tokenizers, vocabulary

VOCABULARY = "piece_bpe_32k.model"
#: Documents of each language that the model is fitted on, at most.
TRAIN_DOCS = 1500
#: Bytes of the table of piece probabilities, at most; about a thousand languages.
MODEL_BYTES = 256 << 20
#: Bytes that the words a worker remembers take; beyond that it forgets and starts anew.
MEMO_BYTES = 32 << 20
#: Bytes of the numbers that one pass over words holds.
PASS_BYTES = 4 << 20
#: Bytes of text whose words a worker holds at once, as strings of several times that size.
TEXT_BYTES = 512 << 10
#: Characters above which a word is passed in blocks.
LONG_WORD = 256
#: Rounds of fitting to expected counts.
ROUNDS = 2
SMOOTHING = 0.1
_WORD = re.compile(r"[^\W\d_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_START = "▁"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _hash(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the rows of a matrix of code points."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(codes.shape[1]):
        h = h * _PRIME + codes[:, k].astype(np.uint64) + np.uint64(1)
    return h


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    #: probability of each piece (rows) in each language (columns), and of a character that no piece covers
    prob: np.ndarray
    unknown: np.ndarray
    prior: np.ndarray

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        hashes = np.zeros(len(self.pieces), dtype=np.uint64)
        by: dict[int, list[int]] = {}
        for i, p in enumerate(self.pieces):
            by.setdefault(len(p), []).append(i)
        for n, at in by.items():
            codes = np.array([[ord(c) for c in self.pieces[i]] for i in at], dtype=np.uint32).reshape(len(at), n)
            hashes[at] = _hash(codes)
        self._order = np.argsort(hashes)
        self._hashes = hashes[self._order]
        self._forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_place", "_table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._table = np.empty((1024, len(self.languages)))

    def _found(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        if not len(self._hashes):
            return np.full(h.shape, -1)
        at = np.minimum(np.searchsorted(self._hashes, h), len(self._hashes) - 1)
        return np.where(self._hashes[at] == h, self._order[at], -1)

    def _steps(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(i, j, piece of each row between i and j or -1) for all i < j that a piece may span, by i."""
        n = codes.shape[1]
        for i in range(n):
            h = np.zeros(len(codes), dtype=np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * _PRIME + codes[:, j - 1].astype(np.uint64) + np.uint64(1)
                yield i, j, self._found(h)

    def _parts(self, words: list[str], whole: bool = False) -> Iterator[tuple[list[int], np.ndarray]]:
        """Positions and code points of words of equal length, so many at once as PASS_BYTES hold; words are marked.

        whole: every step of a pass is held, not only the last ones."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(i)
        lang = max(1, len(self.languages))
        for n, at in by.items():
            per_row = 8 * n * (self.longest + 2 * lang) if whole else max(8 * lang * (self.longest + 3), 4 * n)
            many = max(1, PASS_BYTES // per_row)
            for k in range(0, len(at), many):
                some = at[k : k + many]
                raw = "".join(_START + words[i] for i in some).encode("utf-32-le", "surrogatepass")
                yield some, np.frombuffer(raw, dtype="<u4").reshape(len(some), n)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Logarithm of the sum over all segmentations, a row per word and a column per language."""
        out = np.zeros((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) < LONG_WORD]
        for some, codes in self._parts([words[i] for i in short]):
            out[[short[i] for i in some]] = self._forward(codes)
        for i, w in enumerate(words):
            if len(w) >= LONG_WORD:
                out[i] = self._forward_long(np.frombuffer((_START + w).encode("utf-32-le", "surrogatepass"), dtype="<u4"))
        return out

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        rows, n = codes.shape
        # alpha[j % ring] is the sum for the first j characters, times exp(-scale)
        ring = self.longest + 1
        alpha = np.zeros((ring, rows, len(self.languages)))
        alpha[0] = 1.0
        scale = np.zeros((rows, len(self.languages)))
        here = None
        for i, j, piece in self._steps(codes):
            if j == i + 1:
                if i and i % 8 == 0:  # before sums get too small to hold
                    top = alpha.max(axis=0)
                    top = np.where(top > 0, top, 1.0)
                    alpha /= top
                    scale += np.log(top)
                here = alpha[i % ring].copy()
                alpha[i % ring] = 0.0
            hit = np.nonzero(piece >= 0)[0]
            if len(hit):
                alpha[j % ring][hit] += here[hit] * self.prob[piece[hit]]
            if j == i + 1:  # any character can stand alone
                miss = np.nonzero(piece < 0)[0]
                alpha[j % ring][miss] += here[miss] * self.unknown
        return np.log(np.maximum(alpha[n % ring], 1e-300)) + scale

    def _forward_long(self, codes: np.ndarray) -> np.ndarray:
        """One word, a few thousand characters at a time. The state after a character is the sums of the last
        longest ones; a block is passed from each state with a single one, and all blocks of a stretch side by side."""
        m, lang = self.longest, len(self.languages)
        size = max(m, 64)
        many = max(1, PASS_BYTES // (8 * max(1, lang) * m * (m + 2)))
        state = np.zeros((m, lang))  # state[k]: the sum k characters back
        state[0] = 1.0
        scale = np.zeros(lang)
        at = 0
        while at < len(codes):
            left = len(codes) - at
            blocks = min(many, left // size)
            if not blocks:
                blocks, size = 1, left
            stretch = blocks * size
            # pieces that end at each character of the stretch, by length; they may begin before it
            first = max(0, at - m + 1)
            own = codes[first : at + stretch].astype(np.uint64)
            ends = np.full((m, stretch), -1)
            h = np.zeros(len(own), dtype=np.uint64)
            for n in range(1, m + 1):
                # h[i]: hash of own[i : i + n]
                h = h[: len(own) - n + 1] * _PRIME + own[n - 1 :] + np.uint64(1)
                begin = np.arange(len(h))
                end = begin + n - 1 - (at - first)
                ok = (end >= 0) & (end < stretch)
                ends[n - 1, end[ok]] = self._found(h[ok])
            ends = ends.reshape(m, blocks, size)
            past = np.zeros((m, blocks, m, lang))  # past[k]: sums k characters back, for each block and state begun in
            past[np.arange(m), :, np.arange(m), :] = 1.0
            grown = np.zeros((blocks, m, lang))
            for t in range(size):
                p = np.where(ends[:, :, t, None] >= 0, self.prob[np.maximum(ends[:, :, t], 0)], 0.0) if len(self.prob) else np.zeros((m, blocks, lang))
                p[0] = np.where(ends[0, :, t, None] >= 0, p[0], self.unknown)
                new = np.einsum("rbkl,rbl->bkl", past, p)
                past = np.concatenate([new[None], past[:-1]])
                if t % 8 == 7 or t == size - 1:
                    top = past.max(axis=(0, 2))[:, None, :]
                    top = np.where(top > 0, top, 1.0)
                    past /= top[None]
                    grown += np.log(top)
            for b in range(blocks):
                state = np.einsum("rkl,kl->rl", past[:, b], state)
                top = state.max(axis=0)
                top = np.where(top > 0, top, 1.0)
                state /= top
                scale += np.log(top) + grown[b, 0]
            at += stretch
        return np.log(np.maximum(state[0], 1e-300)) + scale

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected counts of each piece (rows) in each language (columns), over all segmentations of words.

        weights: how often each word (rows) is in each language (columns)."""
        out = np.zeros_like(self.prob)
        lang = len(self.languages)
        for some, codes in self._parts(words, whole=True):
            rows, n = codes.shape
            steps = [(i, j, piece) for i, j, piece in self._steps(codes)]
            alpha, beta = np.zeros((n + 1, rows, lang)), np.zeros((n + 1, rows, lang))
            alpha[0], beta[n] = 1.0, 1.0

            def p(i: int, j: int, piece: np.ndarray) -> np.ndarray:
                other = self.unknown if j == i + 1 else 0.0
                return np.where((piece >= 0)[:, None], self.prob[np.maximum(piece, 0)], other)

            for i, j, piece in steps:
                alpha[j] += alpha[i] * p(i, j, piece)
            for i, j, piece in sorted(steps, key=lambda s: -s[0]):
                beta[i] += beta[j] * p(i, j, piece)
            whole = np.maximum(alpha[n], 1e-300)
            for i, j, piece in steps:
                hit = np.nonzero(piece >= 0)[0]
                if len(hit):
                    share = alpha[i][hit] * self.prob[piece[hit]] * beta[j][hit] / whole[hit]
                    np.add.at(out, piece[hit], share * weights[some][hit])
        return out

    def text_scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) of each text; ("und", 0.0) for null texts and texts without a letter."""
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        own = [words_of(t) if t else [] for t in texts]
        if len(self._place) * (8 * len(self.languages) + 160) > MEMO_BYTES:
            self._forget()
        place = self._place
        # a long word is scored each time and not remembered
        new = list(dict.fromkeys(w for ws in own for w in ws if w not in place and len(w) < LONG_WORD))
        if new:
            at = len(place)
            place.update(zip(new, range(at, at + len(new))))
            if at + len(new) > len(self._table):
                self._table = np.concatenate([self._table[:at], np.empty((at + 2 * len(new), len(self.languages)))])
            self._table[at : at + len(new)] = self.word_scores(new)
        out = []
        for t, ws in zip(texts, own):
            if not has_letter(t):
                out.append(("und", 0.0))
                continue
            total = np.log(self.prior)
            if ws:
                known = [place[w] for w in ws if len(w) < LONG_WORD]
                total = total + self._table[np.array(known, dtype=np.int64)].sum(axis=0)
                if len(known) < len(ws):
                    total = total + self.word_scores([w for w in ws if len(w) >= LONG_WORD]).sum(axis=0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, path: str, train_docs: int = TRAIN_DOCS, text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Fit on at most train_docs documents of each language that are not held out, chosen by a hash of doc_id.

    Rows with a null text, lang or doc_id are not used. Without any such row the model has no languages. Every lang
    value of such a row is a language of the model.
    """
    import sentencepiece

    spark = prepared(docs)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    usable = [i for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and p]
    row_of = {p: i for i, p in enumerate(usable)}
    most = MODEL_BYTES // (8 * max(1, len(usable)))
    labelled = docs.select("doc_id", "lang", F.col(quoted(text_col)).alias("text"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    # a hash bound leaves about twice the documents wanted of each language, so that ranking them is small work at any size
    found = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} languages do not fit a model of {MODEL_BYTES} bytes")
    languages = [r.lang for r in found]
    if not languages:
        return Model([], [pieces[i] for i in usable], np.zeros((len(usable), 0)), np.zeros(0), np.zeros(0))
    bounds = spark.createDataFrame([(r.lang, int(min(1.0, (2 * train_docs + 100) / r.n) * (1 << 31))) for r in found], "__lang string, __bound long")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    near = labelled.select("doc_id", "lang").join(F.broadcast(bounds), (F.col("lang") == F.col("__lang")) & (place < F.col("__bound")))
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= train_docs)
    ids = [r[0] for r in chosen.select("doc_id").distinct().collect()]  # train_docs times languages at most
    sample = labelled.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "__id long")), F.col("doc_id") == F.col("__id"), "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokenizers()
        words: dict[str, Counter] = {}
        docs_of: Counter = Counter()
        for b in batches:
            for at, n in slices(b.column(1), TEXT_BYTES):
                for lang, text in zip(b.column(0).slice(at, n).to_pylist(), b.column(1).slice(at, n).to_pylist()):
                    # only for training, long words are cut
                    words.setdefault(lang, Counter()).update(w[k : k + 64] for w in words_of(text) for k in range(0, len(w), 64))
                    docs_of[lang] += 1
        rows = chain(((lang, None, n) for lang, n in docs_of.items()), ((lang, w, n) for lang, c in words.items() for w, n in c.items()))
        while some := list(islice(rows, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.string()), pa.array([r[1] for r in some], pa.string()), pa.array([r[2] for r in some], pa.int64())], ["lang", "word", "n"])
        del words, rows, some
        released()

    words = written(sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    n_docs = {r.lang: r.n for r in words.where("word is null").collect()}
    column_of = {lang: i for i, lang in enumerate(languages)}
    prior = np.array([n_docs.get(x, 0) for x in languages], dtype=float)

    def made(counts: np.ndarray) -> Model:
        prob = counts + SMOOTHING
        total = prob.sum(axis=0) + SMOOTHING
        return Model(languages, [pieces[i] for i in usable], prob / total, SMOOTHING / total, np.maximum(prior, 0.5) / max(prior.sum(), 1.0))

    def rows_of(counts: np.ndarray) -> pa.RecordBatch:
        at = np.nonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(counts[at])], ["piece", "lang", "n"])

    def counted(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
        """Counts of pieces: those of one segmentation, or with a model the expected ones."""
        forget_tokenizers()
        out = np.zeros((len(usable), len(languages)))
        if model is None:
            own = sentencepiece.SentencePieceProcessor(model_file=path)
        for b in batches:
            at: dict[str, int] = {}
            some = b.column(1).to_pylist()
            rows = np.array([at.setdefault(w, len(at)) for w in some], dtype=np.int64)
            column = np.array([column_of[x] for x in b.column(0).to_pylist()], dtype=np.int64)
            n = b.column(2).to_numpy(zero_copy_only=False).astype(float)
            if model is None:
                for ids_, c, x in zip(own.encode(some, num_threads=1), column, n):
                    for i in ids_:
                        if i in row_of:
                            out[row_of[i], c] += x
            else:
                weights = np.zeros((len(at), len(languages)))
                np.add.at(weights, (rows, column), n)
                out += model.expected(list(at), weights)
        yield rows_of(out)
        del out
        released()

    model = None
    for _ in range(1 + rounds):
        sent = spark.sparkContext.broadcast(model)
        got = words.where("word is not null").mapInArrow(lambda batches, sent=sent: counted(batches, sent.value), "piece int, lang int, n double")
        # vocabulary times languages at most; sums of doubles are rounded so that their order does not show
        rows = got.groupBy("piece", "lang").agg(F.round(F.sum("n"), 6).alias("n")).toPandas()
        counts = np.zeros((len(usable), len(languages)))
        counts[rows["piece"].to_numpy(), rows["lang"].to_numpy()] = rows["n"].to_numpy()
        model = made(counts)
    return model


def _scorer(model: Model):
    """texts to (language, posterior), with one copy of the model in a worker for as long as a scan lasts."""
    spark = SparkSession.getActiveSession()
    sent = spark.sparkContext.broadcast(model)

    def scores(column: pa.Array) -> list[tuple[str, float]]:
        forget_tokenizers()
        m = sent.value
        return [x for at, n in slices(column, TEXT_BYTES) for x in m.text_scores(column.slice(at, n).to_pylist())]

    def end() -> None:
        sent.value._forget()
        released()

    return scores, end


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (the posterior of lang_pred, 0 to 1).

    Only the text is looked at. lang_pred is "und" with score 0 if the text is null or has no letter, or if the model
    has no languages. Of languages that score alike the first in alphabetical order is told. Very long words are scored
    like any other. Repeated rows give repeated rows; an empty table gives an empty result.
    """
    prepared(docs)
    scores, end = _scorer(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])
        end()

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(scan, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, path: str, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs whose language is told: not "und" and with a posterior of least_score or more. Columns as in docs.

    Each row is judged by its own text inside the scan, so rows with a null or repeated doc_id are nothing special and
    no text is shuffled.
    """
    prepared(docs)
    scores, end = _scorer(train(docs, path, text_col=text_col))
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = scores(b.column(at))
            yield b.filter(pa.array([x[0] != "und" and x[1] >= least_score for x in got], pa.bool_()))
        end()

    return docs.mapInArrow(scan, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs, vocabulary(VOCABULARY)))
