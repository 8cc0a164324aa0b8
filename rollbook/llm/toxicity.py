"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a learnt vector (words seen twice in training have their own, all others
share one) beside a vector read from its characters: a small bidirectional GRU over its
UTF-8 bytes with attention pooling. A second bidirectional GRU with attention pooling reads
windows of 32 words, each overlapping half of the next, and gives the odds of each window.
All windows of a text are scored, and its score is that of the worst one.

Training takes a bounded sample of labelled rows (`POSITIVE`, `NEGATIVE`), the first by a
hash of the id; rows whose crc32(doc_id) is divisible by five are never among them. Labels
belong to texts and not to windows, so each round scores all windows of the sample and
learns from the worst of each text. One task trains; the model of about a megabyte is
broadcast. Only the text is an input of a score.

Cases: null, empty and blank texts have the score 0. Words of more than 24 bytes are read as
several. Repeated rows get equal scores. Without labels of both kinds every score is 0.
Empty tables give empty results. `accepted` keeps all columns, whatever their names.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import arrow_rows, importable, plain_words, text_of

#: Kind of all weights and states.
REAL = np.float32
#: Labelled rows of each kind that training takes at most.
POSITIVE, NEGATIVE = 1200, 2400
FOLDS, CALIBRATE = 5, 5
WINDOW, STEP = 32, 16
LETTERS = 24
CHAR_DIM, CHAR_HIDDEN, WORD_DIM, HIDDEN = 8, 8, 8, 8
VOCABULARY = 20_000
ROUNDS, BATCH, RATE = 6, 128, 6e-3
#: Windows computed at once, words of a text kept at once, and words with a known input.
WIDTH, CHUNK, MEMO = 512, 200_000, 150_000


def pieces(text: str) -> list[bytes]:
    words = plain_words(text)
    if words and max(map(len, words)) > LETTERS:
        words = [w[i : i + LETTERS] for w in words for i in range(0, len(w), LETTERS)]
    return words


def letters(words: list[bytes]) -> np.ndarray:
    """Bytes of the words, zero behind their end."""
    return np.frombuffer(b"".join(w.ljust(LETTERS, b"\0") for w in words), np.uint8).reshape(-1, LETTERS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Reader:
    """Bidirectional GRU with attention pooling over projected inputs, forward and backward.

    Arrays have the direction first: inputs (2, batch, time, 3 hidden), the second direction
    already reversed in time by `both`.
    """

    def __init__(self, weights: dict[str, np.ndarray], name: str, hidden: int):
        self.w, self.name, self.hidden = weights, name, hidden

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[self.name + "_in"] + self.w[self.name + "_bias"]

    def both(self, inputs: np.ndarray) -> np.ndarray:
        """(batch, time, 6 hidden) as two directions."""
        half = 3 * self.hidden
        return np.stack([inputs[:, :, :half], inputs[:, ::-1, half:]])

    def states(self, inputs: np.ndarray, there: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """A step that is not there leaves the state as it is, so padding changes nothing."""
        h, u = self.hidden, self.w[self.name + "_own"]
        state = np.zeros((2, inputs.shape[1], h), REAL)
        out = np.empty((*inputs.shape[:3], h), REAL)
        for t in range(inputs.shape[2]):
            x, own = inputs[:, :, t], state @ u
            gates = _sigmoid(x[..., : 2 * h] + own[..., : 2 * h])
            reset, hold = gates[..., :h], gates[..., h:]
            new = np.tanh(x[..., 2 * h :] + reset * own[..., 2 * h :])
            move = 1 - hold if there is None else (1 - hold) * there[:, :, t]
            if keep is not None:
                keep.append((state, own, reset, hold, new, move))
            state = state + move * (new - state)
            out[:, :, t] = state
        return out

    def pool(self, out: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention over the steps that are there: pooled (batch, 2 hidden), weights, joined states."""
        joined = np.concatenate([out[0], out[1][:, ::-1]], axis=2)
        odds = np.where(there, joined @ self.w[self.name + "_look"], REAL(-30))
        weight = np.exp(odds - odds.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        return (weight[:, None] @ joined)[:, 0], weight, joined

    def read(self, inputs: np.ndarray, there: np.ndarray) -> np.ndarray:
        every = None if there.all() else self.both_there(there)
        return self.pool(self.states(self.both(inputs), every), there)[0]

    def both_there(self, there: np.ndarray) -> np.ndarray:
        return np.stack([there, there[:, ::-1]])[..., None].astype(REAL)

    def learn(self, inputs: np.ndarray, there: np.ndarray):
        """Pooled vectors, and a function from their gradients to those of the inputs."""
        keep: list = []
        directions, every = self.both(inputs), self.both_there(there)
        pooled, weight, joined = self.pool(self.states(directions, every, keep), there)

        def back(d_pooled: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
            h, name, u = self.hidden, self.name, self.w[self.name + "_own"]
            d_weight = (joined @ d_pooled[:, :, None])[..., 0]
            d_odds = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
            d_joined = weight[..., None] * d_pooled[:, None] + d_odds[..., None] * self.w[name + "_look"]
            grads[name + "_look"] += np.tensordot(d_odds, joined, ([0, 1], [0, 1]))
            d_out = np.stack([d_joined[..., :h], d_joined[:, ::-1, h:]])
            d_in, d_u = np.empty_like(directions), np.zeros_like(u)
            d_state = np.zeros_like(d_out[:, :, 0])
            for t in range(d_out.shape[2] - 1, -1, -1):
                state, own, reset, hold, new, move = keep[t]
                d_state = d_state + d_out[:, :, t]
                d_new = d_state * move * (1 - new * new)
                d_hold = d_state * (state - new) * hold * move
                d_reset = d_new * own[..., 2 * h :] * reset * (1 - reset)
                d_in[:, :, t] = np.concatenate([d_reset, d_hold, d_new], axis=2)
                d_own = np.concatenate([d_reset, d_hold, d_new * reset], axis=2)
                d_u += state.transpose(0, 2, 1) @ d_own
                d_state = d_state * (1 - move) + d_own @ u.transpose(0, 2, 1)
            grads[name + "_own"] += d_u
            return np.concatenate([d_in[0], d_in[1][:, ::-1]], axis=2)

        return pooled, back


class Model:
    def __init__(self, vocabulary: dict[bytes, int], weights: dict[str, np.ndarray] | None = None):
        self.vocabulary = vocabulary
        if weights is None:
            rng = np.random.default_rng(7)
            shape = {
                "letter": (256, CHAR_DIM), "word": (len(vocabulary) + 1, WORD_DIM),
                "chars_in": (CHAR_DIM, 6 * CHAR_HIDDEN), "chars_bias": (6 * CHAR_HIDDEN,), "chars_own": (2, CHAR_HIDDEN, 3 * CHAR_HIDDEN), "chars_look": (2 * CHAR_HIDDEN,),
                "words_in": (WORD_DIM + 2 * CHAR_HIDDEN, 6 * HIDDEN), "words_bias": (6 * HIDDEN,), "words_own": (2, HIDDEN, 3 * HIDDEN), "words_look": (2 * HIDDEN,),
                "odds": (2 * HIDDEN,), "odds_bias": (1,),
            }
            weights = {k: (rng.standard_normal(s) * (0.0 if "bias" in k else 0.1 if k == "word" else 0.35)).astype(REAL) for k, s in shape.items()}
            weights["odds_bias"] -= 2
            weights["cut"] = np.zeros(1, REAL)
        self.weights = weights
        self.chars, self.words = Reader(weights, "chars", CHAR_HIDDEN), Reader(weights, "words", HIDDEN)

    def known(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.vocabulary.get(w, 0) for w in words], np.int64)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Projected input of the word reader for each word, by groups of like length."""
        out = np.empty((len(words), 6 * HIDDEN), REAL)
        sizes = np.array([len(w) for w in words])
        by_letter = self.chars.project(self.weights["letter"])
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), WIDTH):
            group = order[at : at + WIDTH]
            some = [words[i] for i in group]
            ids = letters(some)[:, : sizes[group[-1]]]
            read = self.chars.read(by_letter[ids], ids > 0)
            out[group] = self.words.project(np.concatenate([self.weights["word"][self.known(some)], read], axis=1))
        return out

    def odds(self, read: np.ndarray) -> np.ndarray:
        return read @ self.weights["odds"] + self.weights["odds_bias"]

    def step(self, lists: list[list[bytes]], labels: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Adds the gradients of the log loss over some windows."""
        w = self.weights
        unique = list(dict.fromkeys(x for words in lists for x in words))
        number = {x: i for i, x in enumerate(unique)}
        index = np.full((len(lists), WINDOW), len(unique))
        for n, words in enumerate(lists):
            index[n, : len(words)] = [number[x] for x in words]
        ids = letters(unique)[:, : max(map(len, unique))]
        read, back_chars = self.chars.learn(self.chars.project(w["letter"])[ids], ids > 0)
        known = self.known(unique)
        x = np.concatenate([w["word"][known], read], axis=1)
        padded = np.concatenate([self.words.project(x), np.zeros((1, 6 * HIDDEN), REAL)])
        pooled, back_words = self.words.learn(padded[index], index < len(unique))
        d_odds = ((_sigmoid(self.odds(pooled)) - labels) / len(labels)).astype(REAL)
        grads["odds"] += pooled.T @ d_odds
        grads["odds_bias"] += d_odds.sum()
        d_steps = back_words(d_odds[:, None] * w["odds"], grads)
        d_project = np.zeros_like(padded)
        np.add.at(d_project, index.ravel(), d_steps.reshape(-1, 6 * HIDDEN))
        d_project = d_project[:-1]
        grads["words_in"] += x.T @ d_project
        grads["words_bias"] += d_project.sum(axis=0)
        d_x = d_project @ w["words_in"].T
        np.add.at(grads["word"], known, d_x[:, :WORD_DIM])
        d_letters = back_chars(np.ascontiguousarray(d_x[:, WORD_DIM:]), grads)
        by_letter = np.zeros((256, 6 * CHAR_HIDDEN), REAL)
        np.add.at(by_letter, ids.ravel(), d_letters.reshape(-1, 6 * CHAR_HIDDEN))
        grads["chars_in"] += w["letter"].T @ by_letter
        grads["chars_bias"] += by_letter.sum(axis=0)
        grads["letter"] += by_letter @ w["chars_in"].T


def window_starts(n: int) -> range:
    return range(0, max(n - STEP, 1), STEP)


class Scorer:
    """Scores of texts; the inputs of words met before are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.table = np.zeros((1, 6 * HIDDEN), REAL)

    def _add(self, words: list[bytes]) -> None:
        if len(self.memo) + len(words) > MEMO:
            self._reset()
            words = list(dict.fromkeys(words))
        self.memo.update(zip(words, range(len(self.table), len(self.table) + len(words)), strict=True))
        self.table = np.concatenate([self.table, self.model.inputs(words)])

    def windows(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Score and text of every window of all texts."""
        flat = [w for words in texts for w in words]
        new = set(flat)
        if len(self.memo) + len(new.difference(self.memo)) > MEMO:
            self._reset()
        missing = sorted(new.difference(self.memo))
        if missing:
            self._add(missing)
        ids = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        ids = np.concatenate([ids, np.zeros(1, np.int64)])
        sizes = np.array([len(words) for words in texts])
        count = np.array([len(window_starts(n)) for n in sizes])
        owner = np.repeat(np.arange(len(texts)), count)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start, end = begin[owner] + place * STEP, begin[owner + 1]
        scores = np.empty(len(owner), REAL)
        for at in range(0, len(owner), WIDTH):
            index = start[at : at + WIDTH, None] + np.arange(WINDOW)
            there = index < end[at : at + WIDTH, None]
            there[:, 0] = True
            inputs = self.table[ids[np.where(there, index, len(flat))]]
            scores[at : at + WIDTH] = _sigmoid(self.model.odds(self.model.words.read(inputs, there)) - self.model.weights["cut"])
        return scores, owner

    def scores(self, texts) -> list[float]:
        """The score of each text: its worst window, over all of them."""
        out: list[float] = []
        waiting: list[list[bytes]] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            found, owner = self.windows(waiting)
            for n, score in zip(np.array(owners)[owner].tolist(), found.tolist(), strict=True):
                out[n] = max(out[n], score)
            waiting.clear()
            owners.clear()

        for n, text in enumerate(texts):
            words = pieces(text)
            out.append(0.0)
            # a text beyond the chunk goes in parts that share a step, so no window is lost
            for at in range(0, max(len(words) - STEP, 1), CHUNK) if words else ():
                part = words[at : at + CHUNK + STEP]
                waiting.append(part)
                owners.append(n)
                size += len(part)
                if size >= CHUNK:
                    flush()
                    size = 0
        if waiting:
            flush()
        return out


def train(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Learns from the worst windows of each text, found anew in each round.

    One text in `CALIBRATE` teaches nothing: on those the odds are found that become a score
    of a half.
    """
    rng = np.random.default_rng(11)
    split = [pieces(t) for t in texts]
    apart = rng.permutation(len(texts)) % CALIBRATE == 0
    counts = Counter(w for words, out in zip(split, apart, strict=True) if not out for w in words)
    vocabulary = {w: n + 1 for n, (w, c) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if c > 1}
    model = Model(vocabulary)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    usable = [n for n, words in enumerate(split) if words and not apart[n]]
    step = 0
    for number in range(rounds):
        chosen: list[tuple[int, int]] = []
        if number:
            scorer = Scorer(model)
            for at in range(0, len(usable), 200):
                block = usable[at : at + 200]
                scores, owner = scorer.windows([split[n] for n in block])
                for k, n in enumerate(block):
                    own = scores[owner == k]
                    worst = np.argsort(-own, kind="stable")[: 1 if labels[n] else 2]
                    chosen += [(n, int(i) * STEP) for i in worst]
                    # windows of a toxic text that are toxic on their own teach as well
                    chosen += [(n, int(i) * STEP) for i in np.flatnonzero(own > 0.8)[:3] if labels[n] and i != worst[0]]
        for n in usable:
            places = list(window_starts(len(split[n])))
            some = rng.choice(len(places), min(len(places), 2 if labels[n] and not number else 3 if not labels[n] else 0), replace=False)
            chosen += [(n, places[i]) for i in some]
        chosen = [chosen[i] for i in rng.permutation(len(chosen))]
        for at in range(0, len(chosen), BATCH):
            batch = chosen[at : at + BATCH]
            grads = {k: np.zeros_like(v) for k, v in model.weights.items()}
            model.step([split[n][s : s + WINDOW] for n, s in batch], labels[[n for n, _ in batch]].astype(REAL), grads)
            step += 1
            rate = RATE * min(1.0, 1.3 - number / rounds)
            for k, g in grads.items():
                if k == "cut":
                    continue
                first, second = moments[k]
                first += 0.1 * (g - first)
                second += 0.002 * (g * g - second)
                model.weights[k] -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.998**step)) + 1e-6)
    scorer = Scorer(model)
    scores = np.array(scorer.scores(texts[n] for n in np.flatnonzero(apart)))
    model.weights["cut"][:] = best_cut(scores, labels[apart])
    return model


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """Log odds with the fewest errors; of a range of such, its middle."""
    if not 0 < labels.sum() < len(labels):
        return 0.0
    odds = np.log(np.clip(scores, 1e-6, 1 - 1e-6) / np.clip(1 - scores, 1e-6, 1))
    order = np.argsort(odds, kind="stable")
    missed = np.concatenate([[0], np.cumsum(labels[order])])  # toxic ones below each border
    wrong = (1 - labels).sum() - np.concatenate([[0], np.cumsum(1 - labels[order])])
    best = np.flatnonzero(missed + wrong == (missed + wrong).min())
    edges = np.concatenate([[odds[order[0]] - 1], odds[order], [odds[order[-1]] + 1]])
    return float((edges[best[0]] + edges[best[-1] + 1]) / 2)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def fitted(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> bytes:
    """The trained model, pickled; empty bytes if the sample lacks one of the labels."""
    spark = docs.sparkSession
    importable(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("turn", F.xxhash64("doc_id"))
    kinds = [known.where(c).orderBy("turn", "doc_id").limit(n) for c, n in (("toxic = 1", positive), ("toxic = 0", negative))]
    sample = kinds[0].union(kinds[1])
    texts = docs.select(F.col("doc_id"), text_of().alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))

    def run(parts):
        parts = list(parts)
        frame = pd.concat(parts).sort_values("doc_id") if parts else pd.DataFrame({"text": [], "toxic": []})
        y = frame["toxic"].to_numpy(np.int64)
        model = train(frame["text"].tolist(), y) if 0 < y.sum() < len(y) else None
        yield pd.DataFrame({"model": [pickle.dumps((model.vocabulary, model.weights)) if model else b""]})

    rows = texts.repartition(1).mapInPandas(run, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else b""


def _scorer(raw: bytes) -> Scorer | None:
    return Scorer(Model(*pickle.loads(raw))) if raw else None


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = _scorer(shared.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = (x.as_py() for x in batch.column("text"))
            scores = scorer.scores(texts) if scorer else [0.0] * batch.num_rows
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

        return each

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return arrow_rows(source, make, "doc_id long, score double")


def accepted(docs: DataFrame, model: bytes, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def make():
        scorer = _scorer(shared.value)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            if scorer is None:
                return batch
            scores = scorer.scores(x.as_py() or "" for x in batch.column(place))
            return batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

        return each

    return arrow_rows(docs, make, docs.schema)


def judged(docs: DataFrame, model: bytes) -> DataFrame:
    rows = score(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
