"""Scores of a hashed maximum-entropy language model with a class-factored softmax.

Tokens are the leaves of a tree of classes: the vocabulary, in order of the tokens'
endings, is cut into two classes of about equal counts, and each class again down to the
token itself. The probability of a token is the product of the softmaxes along its path.
Each adds to the classes' add-one counts the weights of its features: the token before
(the 2-gram) and the one before that (a skip), each hashed with the class into a table of
weights. With all weights zero the model is the add-one unigram model.

Counts cover every training text, and every place of every training text trains. The
rows are dealt into as many turns whatever their number, and a pass takes one step for each.
In a turn all tasks sum up, at common weights, the errors of the steps that met a weight and
the number of these steps; Spark adds up the sums in a tree, and each weight moves by its
error and the slope of a penalty on its square, over a quarter of its steps (the most that
the loss can curve) and the penalty. So a weight that few steps met stays small, and the more
evidence there is for it the freer it is. Nothing in the method goes by the size of the input.
Texts are tokenised twice, once to count and once to number their tokens; training and
scoring read the stored numbers.

Frequent tokens travel to the tasks in arrays of bounded length. All others share a
leaf, below which they go by their counts, joined in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources.scratch import materialise

#: Tokens before a place that its features see, and the features.
BACK, FEATURES = 2, 2
#: Bytes of text that a task encodes at once, and places that it scores or learns from at once.
SLICE, PLACES = 1 << 21, 8192
#: Tokens that a task sums up, weights that travel in a row, and sums that are added up in turn in the tree's first level.
TASK_TOKENS, PART, SALTS = 1 << 22, 1 << 16, 16
#: Steps of a pass, and passes over the training rows, for tables of any size.
TURNS, PASSES = 4, 1
#: Step over the curvature's bound, and the penalty on half of a weight's square.
RATE, PENALTY = 0.6, 4.0
#: Rows that are no common batch: of a pass's last turn, and not to learn from.
WATCHED, HELD_OUT = -1, -2
#: Leaves that are no token: the end of a text, and all tokens that aren't frequent.
END, OTHER = 0, 1


class Vocabulary(NamedTuple):
    """Frequent tokens by sorted hash with their leaves and log10(count + 1), and the sums of all tokens."""

    hashes: np.ndarray
    leaves: np.ndarray
    logs: np.ndarray
    end_log: float
    tokens: int
    distinct: int


class Tree(NamedTuple):
    """The path of leaf i: its nodes, and whether it goes to the second class, from ``starts[i]`` to ``starts[i + 1]``; and each node's log odds of the second class by counts."""

    starts: np.ndarray
    nodes: np.ndarray
    second: np.ndarray
    odds: np.ndarray
    other_log: float  # log10 of the counts below the leaf of all other tokens


def token_hash(token: bytes) -> int:
    value = xxhash.xxh64_intdigest(token, 42)
    return value - (1 << 64) if value >= 1 << 63 else value


def ending(token: bytes) -> int:
    """A number that orders tokens by their last seven bytes, from the last one on."""
    return int.from_bytes(token[: -8 : -1].ljust(7, b"\x00"), "big")


def split_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The texts' token counts, all tokens as numbers in order, and the distinct tokens.

    Tokens are runs of other than space and ASCII white space, with A-Z lower-cased.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    numbered = lists.flatten().dictionary_encode()
    distinct = numbered.dictionary.cast(pa.binary()).to_pylist()
    numbers = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    if b"" in distinct:  # before the first and after the last white space of a text
        real = numbers != distinct.index(b"")
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        numbers = numbers[real]
    return np.diff(ends, prepend=0), numbers, distinct


def in_slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in slices of about ``most`` bytes of text; a longer text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        firsts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for begin, end in zip(firsts, [*firsts[1:], batch.num_rows], strict=True):
            yield batch.slice(begin, end - begin)
    pa.default_memory_pool().release_unused()  # the worker stays for other tasks


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, ending, n): occurrences of each token, told apart by 64-bit hash, summed in each slice before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_slices(batches, 32 << 20):
            _, numbers, distinct = split_tokens(rows.column("text"))
            times = np.bincount(numbers, minlength=len(distinct))
            found = [(token_hash(t), ending(t), n) for t, n in zip(distinct, times.tolist(), strict=True) if n and t]
            h, k, n = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["h", "ending", "n"])

    return texts.select("text").mapInArrow(count, "h long, ending long, n long").groupBy("h", "ending").agg(F.sum("n").alias("n"))


def class_tree(endings: np.ndarray, counts: np.ndarray, ends: int, other: int) -> Tree:
    """Cut the tokens, in order of their endings, into two classes of about equal counts, and each class again until it is one token.

    Leaves are numbered END, OTHER, then the tokens as given. ``other`` is the add-one
    sum of all other tokens.
    """
    weights = np.concatenate([[ends + 1, other], counts + 1]).astype(np.float64)
    order = np.concatenate([[END, OTHER], 2 + np.argsort(endings, kind="stable")])
    sums = np.concatenate([[0.0], np.cumsum(weights[order])])
    low, high = np.array([0]), np.array([len(order)])
    leaves, nodes, second, odds, made = [], [], [], [], 0
    while len(low):
        middle = (sums[low] + sums[high]) / 2
        cut = np.searchsorted(sums, middle)
        cut = np.clip(cut - (sums[cut] - middle > middle - sums[cut - 1]), low + 1, high - 1)
        odds.append(np.log((sums[high] - sums[cut]) / (sums[cut] - sums[low])))
        size = high - low
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        leaves.append(order[at].astype(np.int32))
        nodes.append(np.repeat(np.arange(made, made + len(low), dtype=np.int32), size))
        second.append(at >= np.repeat(cut, size))
        made += len(low)
        low, high = np.concatenate([low, cut]), np.concatenate([cut, high])
        low, high = low[high - low > 1], high[high - low > 1]
    leaf = np.concatenate(leaves)
    by_leaf = np.argsort(leaf, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=len(order)))])
    return Tree(starts, np.concatenate(nodes)[by_leaf], np.concatenate(second)[by_leaf], np.concatenate(odds).astype(np.float32), float(np.log10(other)))


def vocabulary(counts: DataFrame, ends: int, frequent: int) -> tuple[Vocabulary, Tree, DataFrame]:
    """The frequent tokens (``frequent`` at most, cut at a count), their tree, and the table of the others."""
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log2(F.col("n") / 4096) * 64)).cast("long")
    steps = sorted(((r["step"], r["k"], r["least"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).collect()), reverse=True)
    least, total = None, 0
    for _, k, low in steps:
        if total + k > frequent:
            break
        least, total = low, total + k
    kept = counts.filter(F.col("n") >= least if least is not None else F.lit(False))
    rows = kept.toPandas().sort_values("h")
    n = rows["n"].to_numpy(np.int64)
    all_tokens, all_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tree = class_tree(rows["ending"].to_numpy(np.int64), n, ends, int(all_tokens - n.sum()) + int(all_distinct - len(n)) + 1)
    found = Vocabulary(rows["h"].to_numpy(np.int64), np.arange(2, len(n) + 2, dtype=np.int32), np.log10(n + 1.0), float(np.log10(ends + 1)), int(all_tokens) + ends, int(all_distinct) + (ends > 0))
    return found, tree, counts.filter(F.col("n") < least if least is not None else F.lit(True)).select("h", "n")


def numbered_texts(docs: DataFrame, words: Vocabulary, keep: list[str]) -> DataFrame:
    """rid, batch, turn, the columns ``keep``, leaves (of the tokens and the end), known and logs of the frequent tokens, and the other tokens' hashes with their counts (rare, times); stored."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shipped.value
        rid = TaskContext.get().partitionId() << 40
        for rows in in_slices(batches, SLICE):
            lengths, ids, distinct = split_tokens(rows.column("text"))
            hashes = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in distinct), np.uint64, len(distinct)).view(np.int64)
            leaf, log = np.full(len(distinct), OTHER, np.int32), np.zeros(len(distinct))
            if len(words.hashes) and len(hashes):
                at = np.minimum(np.searchsorted(words.hashes, hashes), len(words.hashes) - 1)
                frequent = words.hashes[at] == hashes
                leaf[frequent], log[frequent] = words.leaves[at[frequent]], words.logs[at[frequent]]
            ends = np.cumsum(lengths)
            firsts = ends - lengths
            sums = np.concatenate([[0.0], np.cumsum(log[ids])])
            rare = leaf[ids] == OTHER
            seen = np.concatenate([[0], np.cumsum(~rare)])
            leaves = np.insert(leaf[ids], ends, END)
            rare_h, rare_n, rare_at = [], [], hashes[ids[rare]]
            rare_ends = (ends - seen[ends]).tolist()
            for a, b in zip([0, *rare_ends[:-1]], rare_ends, strict=True):
                u, k = np.unique(rare_at[a:b], return_counts=True) if b > a else (rare_at[:0], rare_at[:0])
                rare_h.append(u)
                rare_n.append(k)
            kept = [rows.column(rows.schema.get_field_index(k)) for k in keep]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths + 1)]), pa.int32()), pa.array(leaves, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(lengths))), *kept, lists, pa.array(seen[ends] - seen[firsts]), pa.array(sums[ends] - sums[firsts] + words.end_log), pa.array(rare_h, pa.list_(pa.int64())), pa.array(rare_n, pa.list_(pa.int64()))], names=["rid", *keep, "leaves", "known", "logs", "rare", "times"])
            rid += len(lengths)

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    numbered = docs.select(*keep, "text").mapInArrow(number, f"rid long, {kinds}, leaves array<int>, known long, logs double, rare array<long>, times array<long>")
    turn = F.pmod(F.xxhash64("rid"), F.lit(TURNS)).cast("int")
    learnt = F.when(turn < TURNS - 1, 0).otherwise(WATCHED)
    batch = F.when(F.col("held_out"), HELD_OUT).otherwise(learnt) if "held_out" in keep else learnt
    return materialise(numbered.withColumn("batch", batch).withColumn("turn", turn), "numbered-texts", ["batch", "turn"])


def flat_leaves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lengths, and their leaves one after another, each text led by pads (-1)."""
    lengths = np.asarray(pc.list_value_length(column), np.int64)
    leaves = np.asarray(column.flatten(), np.int64)
    firsts = np.cumsum(lengths) - lengths
    return lengths, np.insert(leaves, np.repeat(firsts, BACK), -1)


def places_of(lengths: np.ndarray) -> np.ndarray:
    """Where tokens and ends stand among the pads."""
    starts = np.cumsum(lengths + BACK) - lengths
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


#: Odd factors that mix contexts and nodes into places of the table.
MIX = [np.uint32(xxhash.xxh32_intdigest(str(i).encode(), 7) | 1) for i in range(5)]


def contexts(c: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash for each feature at each place: the 2-gram and the skip."""
    return [(c[at - 1] + 1).astype(np.uint32) * MIX[0] + np.uint32(1), (c[at - 2] + 1).astype(np.uint32) * MIX[1] + np.uint32(7)]


def decisions(tree: Tree, weights: np.ndarray, c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each step on each place's path: where the place's steps begin, the log odds of the second class, whether that is taken, and the weights' places (features x steps)."""
    leaf = c[at]
    first, n = tree.starts[leaf], tree.starts[leaf + 1] - tree.starts[leaf]
    begins = np.cumsum(n) - n
    place = np.repeat(np.arange(len(at)), n)
    step = np.arange(len(place)) + (first - begins)[place]
    node = tree.nodes[step]
    mark = node.astype(np.uint32) * MIX[2]
    mark ^= mark >> np.uint32(16)
    shift = np.uint32(33 - len(weights).bit_length())
    rows, odds = np.empty((FEATURES, len(step)), np.int64), tree.odds[node]
    for f, h in enumerate(contexts(c, at)):
        one = h[place]
        one ^= mark
        one *= MIX[3]
        one ^= one >> np.uint32(15)
        one *= MIX[4]
        one >>= shift
        rows[f] = one
        odds += weights[rows[f]]
    return begins, np.clip(odds, -20, 20, out=odds), tree.second[step], rows


def taken(odds: np.ndarray, second: np.ndarray | bool) -> np.ndarray:
    """The probability of each step, by the log odds of the second class and whether it is taken."""
    return 1 / (1 + np.exp(np.where(second, -odds, odds)))


def add_errors(tree: Tree, weights: np.ndarray, c: np.ndarray, at: np.ndarray, errors: np.ndarray, steps: np.ndarray) -> float:
    """Add each step's error and its number to what it met of ``errors`` and ``steps``; the loss of the places."""
    loss = 0.0
    for begin in range(0, len(at), PLACES):
        _, odds, second, rows = decisions(tree, weights, c, at[begin : begin + PLACES])
        chosen = taken(odds, second)
        loss -= float(np.log(chosen, dtype=np.float64).sum())
        error = np.where(second, chosen - 1, 1 - chosen)
        for r in rows:
            np.add.at(errors, r, error)
            np.add.at(steps, r, np.float32(1))
    return loss


def summed_errors(texts: DataFrame, tree: Tree, weights: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The errors and the numbers of the steps that met each weight, summed over all places of the texts, and the loss.

    A task sends as much as the table of weights twice, so there is one for each TASK_TOKENS
    of ``tokens`` in all: what is sent grows with the texts. Their rows are added up one after another, by part and (of many tasks) salt first and
    then by part, so that no worker holds more than one sum of each part.
    """
    sc = texts.sparkSession.sparkContext
    shipped = sc.broadcast((tree, weights))
    tasks = max(1, -(-tokens // TASK_TOKENS))
    salts = SALTS if tasks > SALTS else 1
    kinds = "part int, salt int, errors binary, steps binary, loss double"

    def rows_of(sums: dict[int, tuple[np.ndarray, np.ndarray, float]], salt: int) -> Iterator[pa.RecordBatch]:
        for part, (errors, steps, loss) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([salt], pa.int32()), pa.array([errors.astype(np.float32).tobytes()]), pa.array([steps.astype(np.float32).tobytes()]), pa.array([loss])], names=["part", "salt", "errors", "steps", "loss"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, own = shipped.value
        errors, steps, loss = np.zeros(len(own), np.float32), np.zeros(len(own), np.float32), 0.0
        seen = False
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                lengths, c = flat_leaves(batch.column("leaves").slice(begin, 64))
                loss += add_errors(tree, own, c, places_of(lengths), errors, steps)
                seen = True
        if seen:
            salt = TaskContext.get().partitionId() % salts
            yield from rows_of({i: (errors[at : at + PART], steps[at : at + PART], 0.0 if i else loss) for i, at in enumerate(range(0, len(own), PART))}, salt)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part, salt, e, n, loss in zip(*(batch.column(c) for c in ("part", "salt", "errors", "steps", "loss")), strict=True):
                new = [np.frombuffer(e.as_buffer(), np.float32).astype(np.float64), np.frombuffer(n.as_buffer(), np.float32).astype(np.float64), loss.as_py()]
                old = sums.setdefault((part.as_py(), salt.as_py()), new)
                if old is not new:
                    for i, x in enumerate(new):
                        old[i] += x
        for (part, salt), one in sums.items():
            yield from rows_of({part: tuple(one)}, salt)

    sent = texts.select("leaves").coalesce(tasks).mapInArrow(learn, kinds)
    if salts > 1:
        sent = sent.repartition("part", "salt").mapInArrow(add, kinds).withColumn("salt", F.lit(0))
    total = sent.repartition("part").mapInArrow(add, kinds)
    errors, steps, loss = np.zeros(len(weights), np.float32), np.zeros(len(weights), np.float32), 0.0
    for row in total.toLocalIterator():
        at = row["part"] * PART
        errors[at : at + PART], steps[at : at + PART] = np.frombuffer(row["errors"], np.float32), np.frombuffer(row["steps"], np.float32)
        loss += row["loss"]
    shipped.destroy()  # a copy for each round and worker would stay on disk
    return errors, steps, loss


def moved(weights: np.ndarray, errors: np.ndarray, steps: np.ndarray, rate: float, penalty: float, share: float = 1.0) -> np.ndarray:
    """The weights after a step: down their errors and the ``share`` of the penalty that is a batch's, by the most that these can curve."""
    return weights - np.float32(rate) * (errors + np.float32(share * penalty) * weights) / (steps / 4 + np.float32(penalty))


def train_round(texts: DataFrame, tree: Tree, weights: np.ndarray, rate: float, tokens: int, penalty: float = PENALTY, share: float = 1.0) -> np.ndarray:
    """The weights after one step by the summed errors of all places of the texts."""
    errors, steps, _ = summed_errors(texts, tree, weights, tokens)
    return moved(weights, errors, steps, rate, penalty, share)


def train(texts: DataFrame, tree: Tree, bits: int, tokens: int, passes: int = PASSES, rate: float = RATE, penalty: float = PENALTY) -> np.ndarray:
    """Weights after ``passes`` over the training texts, ``tokens`` in all, with a step for each turn."""
    weights = np.zeros(1 << bits, np.float32)
    for _ in range(passes):
        for turn in range(TURNS):
            part = texts.filter((F.col("batch") != HELD_OUT) & (F.col("turn") == turn))
            weights = train_round(part, tree, weights, rate, tokens // TURNS, penalty, 1 / TURNS)
    return weights


def model_scores(texts: DataFrame, tree: Tree, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and model: the log10 probability of each text's leaves, and of its other tokens' share below theirs."""
    shipped = texts.sparkSession.sparkContext.broadcast((tree, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, own = shipped.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                rows = batch.slice(begin, 64)
                lengths, c = flat_leaves(rows.column("leaves"))
                places = places_of(lengths)
                p = np.empty(len(places))
                for at in range(0, len(places), PLACES):
                    begins, odds, second, _ = decisions(tree, own, c, places[at : at + PLACES])
                    p[at : at + PLACES] = np.multiply.reduceat(taken(odds, second), begins, dtype=np.float64)
                p = np.log10(p) - np.where(c[places] == OTHER, tree.other_log, 0)
                model = np.add.reduceat(p, np.cumsum(lengths) - lengths)
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), pa.array(model)], names=[*keep, "model"])

    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keep)
    return texts.select(*keep, "leaves").mapInArrow(score, f"{kinds}, model double")


def language_model_scores(docs: DataFrame, train_on: Column, frequent: int = 262_144, rounds: int = PASSES, bits: int = 21) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Learns from rows for which ``train_on`` holds. ``base_score`` is the add-one unigram
    log10 probability, ``score`` the model's. A text's tokens are its words and one end.
    ``frequent`` bounds the arrays that are sent to the tasks, not what is counted, and
    ``2**bits`` weights are learnt in ``rounds`` passes over every place. Null
    texts are empty: one end. Without training rows nothing is known and both scores go by
    counts of zero. Repeated rows each count and are each scored; other columns are
    ignored. An empty table gives no rows.
    """
    rows = docs.select("doc_id", (~train_on).alias("held_out"), "text")
    training = rows.filter(~F.col("held_out"))
    counts = materialise(count_tokens(training), "token-counts")
    ends = training.select("doc_id").count()
    words, tree, others = vocabulary(counts, ends, frequent)
    texts = numbered_texts(rows, words, ["doc_id", "held_out"])
    weights = np.zeros(1 << bits, np.float32) if rounds == 0 or not ends else train(texts, tree, bits, words.tokens, rounds)
    scored = model_scores(texts.withColumn("n_tokens", F.size("leaves").cast("long")), tree, weights, ["rid", "doc_id", "held_out", "n_tokens", "known", "logs"])
    rare = texts.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("rid", F.col("z.rare").alias("h"), F.col("z.times").alias("times"))
    found = rare.join(others, "h").groupBy("rid").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    floor = float(np.log10(words.tokens + words.distinct + 1))
    return scored.join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.lit(int(ends > 0)) + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
