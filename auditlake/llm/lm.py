"""Scoring texts by a log-bilinear language model, next to smoothed unigram counts.

Counts of all training tokens are one aggregation. The most frequent words, up to a fixed number, go to every task;
the others meet their counts in a join. The neural model predicts a token's class from the classes of the three
tokens before it: a class is one of the frequent words, half as many as the root of the training tokens, the
end of text, or one of a few kinds of other words by their shape; within a kind a word has its smoothed share.

Classes lie in groups of like frequency. The sum of the context's vectors, one table for each place, predicts the group,
and within the group the class, so that a token costs the root of the number of classes. Every training token is
learned from: each task runs noise-contrastive updates over its own texts in numpy, and the parameters, of bounded
size, are averaged over tasks by how often each was used, in rounds that start from the average before. For scoring, batched
matrix products give log-probabilities that sum to one over known and unknown tokens.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_schema, by_rows, documents_of, saved, sliced

MOST_HEAD = 32_768  # words with vectors of their own, at most: some 13 MB of parameters in every task
FREQUENT = 100_000  # words whose counts every task holds, at most
LONGEST_FREQUENT = 64  # bytes; longer words are looked up by join
COUNTED = 300_000  # distinct words a task counts before it passes them on
CONTEXT = 3  # tokens before the predicted one
WIDTH = 24  # components of a class vector
NOISE = 16  # noise tokens for each training token
BATCH = 8192
RATE = 0.1
FIRST_ROUND = 8  # one document in so many is learned from in the first round, the others in the second
PIECE = 1 << 16  # components of a parameter block that travels as one row
SALTS = 32  # partial sums of a block

KINDS = 6  # shapes of words that are not classes of their own
END = b""  # key of the end of text among the words; no word is empty


def tokens_of(text: str) -> list[bytes]:
    """A-Z lowered, cut at ASCII white space; exactly what bytes do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def kind_of(word: bytes) -> int:
    last = word[-1]
    if last == 0x2E:
        return 0
    if last == 0x2C:
        return 1
    if 0x61 <= last <= 0x7A or last >= 0x80:
        return 2 if word.isascii() else 3
    return 4 if 0x30 <= last <= 0x39 else 5


@dataclass
class LogBilinear:
    """Vectors of context classes by place, outputs and biases of groups and, within them, of classes.

    Classes 0 (the end) to `inner` - 1 (the rarest frequent word) lie in groups of `group` each; the kinds, which follow,
    are outputs beside the groups.
    """

    contexts: np.ndarray  # CONTEXT x (classes + 1) x WIDTH; the last class stands before the text
    tops: np.ndarray
    top_biases: np.ndarray
    inner: np.ndarray
    inner_biases: np.ndarray
    top_noise: np.ndarray  # the groups' and kinds' share of the training tokens
    inner_noise: np.ndarray  # the classes' share within their group
    group: int

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 11) -> LogBilinear:
        """Before training; `counts` are those of the classes, the kinds last."""
        rng = np.random.default_rng(seed)
        size, inner = len(counts), len(counts) - KINDS
        group = isqrt(inner - 1) + 1
        counts = counts + 0.5
        starts = np.arange(0, inner, group)
        tops = np.concatenate((np.add.reduceat(counts[:inner], starts), counts[inner:]))
        within = counts[:inner] / np.repeat(tops[: len(starts)], group)[:inner]
        top_noise = tops / tops.sum()
        drawn = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(
            drawn(CONTEXT, size + 1, WIDTH),
            drawn(len(tops), WIDTH),
            np.log(top_noise).astype(np.float32),
            drawn(inner, WIDTH),
            np.log(within).astype(np.float32),
            top_noise,
            within,
            group,
        )

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.contexts, self.tops, self.top_biases, self.inner, self.inner_biases]

    def hidden(self, before: np.ndarray) -> np.ndarray:
        """Sums of the contexts' vectors and, as the last component, the one that biases are multiplied by."""
        out = np.ones((len(before), WIDTH + 1), np.float32)
        sums = out[:, :WIDTH]
        sums[:] = self.contexts[0].take(before[:, 0], axis=0)
        for k in range(1, CONTEXT):
            sums += self.contexts[k].take(before[:, k], axis=0)
        return out

    @property
    def outputs(self) -> list[np.ndarray]:
        """Of groups and kinds, and of classes: vectors with the bias as their last component."""
        return [np.column_stack(x) for x in ((self.tops, self.top_biases), (self.inner, self.inner_biases))]

    def by_group(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """An order of the targets by group, the output each has then among groups and kinds, and each group's slice."""
        groups = len(self.tops) - KINDS
        top = np.where(targets < len(self.inner), targets // self.group, targets - len(self.inner) + groups).astype(np.uint16)  # which are sorted by radix
        order = np.argsort(top, kind="stable")
        top = top[order]
        ends = np.searchsorted(top, np.arange(groups + 1)).tolist()
        return order, top, [(g, slice(a, b)) for g, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b]

    def log_probabilities(self, before: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 P(class | classes before), by target."""
        out = np.empty(len(targets))
        tops, inner = self.outputs
        longest = [np.linalg.norm(x, axis=1).max(initial=0) for x in (tops, inner)]
        for at in range(0, len(targets), 16_384):
            order, top, slices = self.by_group(targets[at : at + 16_384])
            order += at
            hidden, own = self.hidden(before.take(order, axis=0)), targets[order]
            # No score is larger than the product of the longest vectors.
            small = [np.sqrt(np.einsum("ij,ij->i", hidden, hidden).max()) * x < 60 for x in longest]
            logs = _log_softmax_at(hidden @ tops.T, top, small[0])
            for g, rows in slices:
                some = slice(g * self.group, (g + 1) * self.group)
                logs[rows] += _log_softmax_at(hidden[rows] @ inner[some].T, own[rows] - some.start, small[1])
            out[order] = logs
        return out / np.log(10)


def _log_softmax_at(scores: np.ndarray, own: np.ndarray, small: bool = False) -> np.ndarray:
    if not small and (scores.max() > 60 or scores.min() < -60):  # beyond what sums of exponentials hold
        scores -= scores.max(1, keepdims=True)
    wanted = scores.reshape(-1)[np.arange(0, scores.size, scores.shape[1]) + own]
    np.exp(scores, out=scores)
    return wanted - np.log(scores @ np.ones(scores.shape[1], scores.dtype))


class Learner:
    """Noise-contrastive updates of one task's copy of the model, with the use of each parameter."""

    def __init__(self, model: LogBilinear, seed: int):
        # Outputs move with their biases, so the copy's parameters are views of both in one.
        self.contexts, self.outputs = model.contexts.copy(), model.outputs
        views = [part for x in self.outputs for part in (x[:, :WIDTH], x[:, WIDTH])]
        self.model = LogBilinear(self.contexts, *views, model.top_noise, model.inner_noise, model.group)
        self.rng = np.random.default_rng(seed)
        # Numbers of two bytes are sorted by radix.
        self.sorted_as = np.uint16 if model.contexts.shape[1] <= 1 << 16 else np.int32
        # The noise of groups and classes sums to NOISE in each group; what it takes from scores, and its weight.
        noise = [NOISE * share for share in (model.top_noise, model.inner_noise)]
        self.shift = [np.log(x).astype(np.float32) for x in noise]
        self.weight = [(-0.5 * x).astype(np.float32) for x in noise]
        self.squares = [np.full(p.shape, 0.1, np.float32) for p in (self.contexts, *self.outputs)]
        self.used = [np.zeros(p.shape[:-1], np.float32) for p in self.squares]

    def learn(self, before: np.ndarray, targets: np.ndarray) -> None:
        order = self.rng.permutation(len(targets))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            self._step(before.take(some, axis=0), targets.take(some))

    def _step(self, before: np.ndarray, targets: np.ndarray) -> None:
        model = self.model
        order, top, slices = model.by_group(targets)
        before, targets = before.take(order, axis=0), targets.take(order)
        hidden = model.hidden(before)
        back = self._against_noise(0, hidden, top, [(slice(0, len(model.tops)), slice(0, len(top)))])
        if slices:
            inner = slices[-1][1].stop
            parts = [(slice(g * model.group, (g + 1) * model.group), rows) for g, rows in slices]
            back[:inner] += self._against_noise(1, hidden, targets[:inner], parts)
        for k in range(CONTEXT):
            order = np.argsort(before[:, k].astype(self.sorted_as), kind="stable")
            row = before[:, k].take(order)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            state = (self.contexts[k], self.squares[0][k], self.used[0][k])
            _move(*state, row[starts], np.add.reduceat(back.take(order, axis=0), starts), np.diff(starts, append=len(row)))

    def _against_noise(self, which: int, hidden: np.ndarray, own: np.ndarray, parts: list[tuple[slice, slice]]) -> np.ndarray:
        """Tell the targets from noise, of which each output has its expected share; moves outputs, returns what moves the contexts.

        `parts` are the outputs that stand against each other and the rows whose targets are among them.
        """
        outputs, weight = self.outputs[which], self.weight[which]
        # The chance that an example is data, not noise, is (1 + tanh(x / 2)) / 2; of scores x halved before they are made.
        half = outputs * np.float32(0.5)
        half[:, WIDTH] -= np.float32(0.5) * self.shift[which]
        # What an output is told is its weight times (1 + tanh), and for the target the chance that it is noise on top of
        # that. The weights, the same for all rows, are brought in where the arrays are small.
        vectors = outputs[:, :WIDTH] * weight[:, None]
        share = (1 / weight).take(own)
        kept = 1 - np.float32(0.5) * share
        back = np.empty((len(own), WIDTH), np.float32)
        gradient, uses = np.zeros_like(outputs), np.zeros(len(outputs), np.float32)
        for some, rows in parts:
            signal = hidden[rows] @ half[some].T
            np.tanh(signal, out=signal)
            signal += 1
            at = np.arange(0, signal.size, signal.shape[1]) + (own[rows] - some.start)
            flat = signal.reshape(-1)
            flat[at] = flat[at] * kept[rows] + share[rows]
            np.matmul(signal, vectors[some], out=back[rows])
            np.matmul(signal.T, hidden[rows], out=gradient[some])
            uses[some] = len(at)
        gradient *= weight[:, None]
        _move(outputs, self.squares[1 + which], self.used[1 + which], slice(None), gradient, uses)
        return back

    def blocks(self):
        """Number, sums weighted by use, and uses of each block of PIECE components, all parameters in a row."""
        values = _flat(self.model.parameters)
        contexts, top, inner = self.used
        used = [contexts, top, top, inner, inner]
        uses = _flat([np.repeat(u.ravel(), p.size // u.size) for p, u in zip(self.model.parameters, used)])
        for number, at in enumerate(range(0, len(values), PIECE)):
            part = slice(at, at + PIECE)
            if uses[part].any():
                yield number, (values[part].astype("f8") * uses[part]).astype("f4"), uses[part]


def _move(values: np.ndarray, squares: np.ndarray, used: np.ndarray, rows, gradient: np.ndarray, uses) -> None:
    """One step along the gradient of these rows, shorter the larger the gradients have been."""
    own = gradient * gradient
    own += squares[rows]
    squares[rows] = own
    np.sqrt(own, out=own)
    gradient *= np.float32(RATE)
    gradient /= own
    values[rows] += gradient
    used[rows] += uses


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.ravel(a) for a in arrays])


@dataclass
class Vocabulary:
    """What every task holds: frequent words with their counts, classes, and the totals of each kind."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    size: int  # classes
    tokens: int
    distinct: int
    end_count: int
    kind_logs: np.ndarray  # log10 of the divisor within a kind
    class_counts: np.ndarray
    index: dict[bytes, int] = field(default_factory=dict)

    def ready(self) -> Vocabulary:
        self.index = {word: i for i, word in enumerate(self.words)}
        return self

    def looked_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places among the frequent words or -1; classes, the end's last; where a word is not frequent."""
        places = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(places < 0)
        classes = np.empty(len(words) + 1, np.int64)
        classes[:-1] = self.classes[places] if len(self.classes) else 0
        first_kind = self.size - KINDS
        classes[rare] = np.fromiter((first_kind + kind_of(words[i]) for i in rare.tolist()), np.int64, len(rare))
        classes[-1] = 0
        return places, classes, rare


def count_words(docs: DataFrame) -> DataFrame:
    """word, kind, n over all rows; the end of text, one for each row, is the empty word."""
    ddl = "word binary, kind int, n long"
    schema = arrow_schema(ddl)

    def run(batches):
        seen: Counter = Counter()

        def passed():
            words = list(seen)
            kinds = [kind_of(w) if w else -1 for w in words]
            for at in range(0, len(words), 50_000):
                part = slice(at, at + 50_000)
                columns = [words[part], kinds[part], [seen[w] for w in words[part]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            seen.clear()

        for batch in sliced(batches):
            texts = batch.to_pydict()["text"]
            for text in texts:
                seen.update(tokens_of(text))
            seen[END] += len(texts)
            if len(seen) > COUNTED:
                yield from passed()
        yield from passed()

    return docs.mapInArrow(run, ddl).groupBy("word", "kind").agg(F.sum("n").alias("n"))


def _vocabulary(counts: DataFrame, head: int | None, frequent: int) -> Vocabulary:
    short = F.octet_length("word").between(1, LONGEST_FREQUENT)
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    # Levels of counts: a few hundred rows say from which level on all words fit.
    levels = counts.where(short).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, least = 0, 1 << 30
    for row in sorted(levels, key=lambda r: -r.level):
        if total + row.n > frequent:
            break
        total, least = total + row.n, row.level
    rows = counts.where(short & (level >= least)).select("word", "kind", "n").collect()
    rows.sort(key=lambda r: (-r.n, bytes(r.word)))
    kinds = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()
    by_kind = {r.kind: (r.n, r.distinct) for r in kinds}
    end_count = by_kind.get(-1, (0, 0))[0]
    tokens = sum(n for n, _ in by_kind.values())
    top = rows[: min(isqrt(tokens // 4), MOST_HEAD) if head is None else head]
    size = 1 + len(top) + KINDS
    for r in top:
        n, distinct = by_kind[r.kind]
        by_kind[r.kind] = (n - r.n, distinct - 1)
    logs = [np.log10(by_kind.get(k, (0, 0))[0] + 0.5 * (by_kind.get(k, (0, 0))[1] + 1)) for k in range(KINDS)]
    return Vocabulary(
        words=[bytes(r.word) for r in rows],
        counts=np.array([r.n for r in rows], np.int64),
        classes=np.array([i + 1 if i < len(top) else size - KINDS + r.kind for i, r in enumerate(rows)], np.int64),
        size=size,
        tokens=tokens,
        distinct=sum(r.distinct for r in kinds),
        end_count=end_count,
        kind_logs=np.array(logs),
        class_counts=np.array([end_count, *(r.n for r in top), *(by_kind.get(k, (0, 0))[0] for k in range(KINDS))], float),
    )


def _contexts(texts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the tokens of all texts in a row: the classes before, the nearest first, and their own."""
    start = np.full(CONTEXT, size)
    row = np.concatenate([piece for classes in texts for piece in (start, classes)])
    lengths = np.array([len(classes) for classes in texts])
    at = np.arange(lengths.sum()) + np.repeat(np.arange(1, len(texts) + 1) * CONTEXT, lengths)
    return np.stack([row[at - k - 1] for k in range(CONTEXT)], 1).astype(np.int32), row[at]


def _summed(blocks: DataFrame, keys: list[str], ddl: str) -> DataFrame:
    """Sums of the blocks by number (and salt), one at a time, in memory for the blocks of one task alone."""
    schema = arrow_schema(ddl)

    def run(batches):
        sums: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            rows = batch.to_pydict()
            for *key, values, uses in zip(*(rows[k] for k in keys), rows["weighted"], rows["uses"]):
                values, uses = np.frombuffer(values, "f4"), np.frombuffer(uses, "f4")
                held = sums.setdefault(tuple(key), [np.zeros(len(values)), np.zeros(len(values))])
                held[0] += values
                held[1] += uses
        for key, held in sums.items():
            row = dict(zip(keys, key)) | {"weighted": held[0].astype("f4").tobytes(), "uses": held[1].astype("f4").tobytes()}
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    return blocks.repartition(*keys).mapInArrow(run, ddl)


def _round(texts: DataFrame, vocabulary: Vocabulary, model: LogBilinear) -> LogBilinear:
    """Every task learns from all its texts, starting from `model`; the average by use of what they come to."""
    ddl = "salt int, number int, weighted binary, uses binary"
    schema, size = arrow_schema(ddl), vocabulary.size

    def run(batches):
        known, task = vocabulary.ready(), TaskContext.get().partitionId()
        learner = Learner(model, task)
        for batch in sliced(batches):
            found = [known.looked_up(tokens_of(text))[1] for text in batch.to_pydict()["text"]]
            if found:
                learner.learn(*_contexts(found, size))
        for number, weighted, uses in learner.blocks():
            row = [task % SALTS, number, weighted.tobytes(), uses.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    partial = _summed(texts.mapInArrow(run, ddl), ["salt", "number"], ddl)
    whole = _summed(partial.drop("salt"), ["number"], "number int, weighted binary, uses binary")
    flat = _flat(model.parameters).astype("f8")
    for row in whole.toArrow().to_pylist():  # as many components as the model has
        part = slice(row["number"] * PIECE, (row["number"] + 1) * PIECE)
        weighted, uses = np.frombuffer(row["weighted"], "f4"), np.frombuffer(row["uses"], "f4")
        flat[part] = np.where(uses > 0, weighted / np.maximum(uses, 1), flat[part])
    values, at = [], 0
    for p in model.parameters:
        values.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
        at += p.size
    return LogBilinear(*values, model.top_noise, model.inner_noise, model.group)


def train(texts: DataFrame, vocabulary: Vocabulary) -> LogBilinear:
    """Learn from every row once: a small part of the rows first, the others from there."""
    model = LogBilinear.fresh(vocabulary.class_counts)
    first = F.pmod(F.xxhash64("text"), F.lit(FIRST_ROUND)) == 0
    for part in (first, ~first):
        model = _round(texts.where(part), vocabulary, model)
    return model


def score_texts(
    docs: DataFrame, training: Column, head: int | None = None, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    `training` is a condition on doc_id; rows that meet it are learned from, all rows are scored. Scores are log10
    probabilities of the whole text with its end. Null and empty texts have the end alone; null ids and repeated
    rows stay, each its own text (and counted as often as they occur); without training rows every token is
    unknown and equally likely. Other columns are not read. `head` sets the number of words with vectors (by default half
    the root of the training tokens, at most MOST_HEAD), `frequent` the counts each task holds; neither changes base_score.
    What the model comes to depends on how the rows lie in tasks, as with any averaging over tasks.
    """
    docs = documents_of(docs, id_col, text_col)
    learned = docs.where(training).select("text")
    counts = saved(count_words(learned), "word-counts")
    vocabulary = _vocabulary(counts, head, frequent)
    model = train(learned, vocabulary)
    ddl = (
        "row long, doc_id long, n_tokens long, n_known long, base double, model double, "
        "rare array<struct<word: binary, n: int>>"
    )
    rare_type = arrow_schema(ddl).field("rare").type

    def make():
        known = vocabulary.ready()
        size, first_kind = known.size, known.size - KINDS
        logs, is_tail = np.log10(known.counts + 0.5), known.classes >= first_kind
        end_log, total_log = np.log10(known.end_count + 0.5), np.log10(known.tokens + 0.5 * (known.distinct + 1))
        part = TaskContext.get().partitionId() << 40
        seen = [0]

        def step(rows):
            out = {name: [] for name in ("row", "doc_id", "n_tokens", "n_known", "base", "model")}
            rare_words, rare_counts, rare_ends = [], [], [0]
            texts = [tokens_of(text) for text in rows["text"]]
            found = [known.looked_up(words) for words in texts]
            logged = model.log_probabilities(*_contexts([classes for _, classes, _ in found], size)) if found else []
            ends = np.cumsum([len(words) + 1 for words in texts]).tolist()
            for doc_id, words, (places, classes, rare), end in zip(rows["doc_id"], texts, found, ends):
                held = places[places >= 0]
                tail = classes[classes >= first_kind] - first_kind
                out["row"].append(part + seen[0])
                seen[0] += 1
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(len(words) + 1)
                out["n_known"].append(len(held) + (known.end_count > 0))
                out["base"].append(float(logs[held].sum() + end_log - (len(words) + 1) * total_log))
                out["model"].append(
                    float(logged[end - len(words) - 1 : end].sum() + logs[held[is_tail[held]]].sum() - known.kind_logs[tail].sum())
                )
                times = Counter(map(words.__getitem__, rare.tolist()))
                rare_words.extend(times)
                rare_counts.extend(times.values())
                rare_ends.append(len(rare_words))
            pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int32())], fields=list(rare_type.value_type))
            out["rare"] = pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pairs, type=rare_type)
            return out

        return step

    rows = saved(by_rows(docs, ddl, make), "scored")
    looked = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    looked = looked.join(counts.select("word", "n"), "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    sums = looked.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("rare_log"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return rows.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + zero("rare_known")).cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_log")).alias("base_score"),
        (F.col("model") + zero("rare_log")).alias("score"),
    )
