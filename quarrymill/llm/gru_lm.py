"""Language-model scores: a gated recurrent network with a class-factored softmax, in numpy.

Counting: tokens are words between white space (A-Z lower-cased) and one end per document. All training
documents are counted, by workers first; the base score of a text is its add-one unigram log10 probability.

Model: the `head` most frequent words are the network's vocabulary, sorted by frequency and cut into
classes; a word's probability is that of its class times that of the word within the class. Rarer words
share one token; their own probability given that token is add-one unigram over the rarer words. So a text has a
proper probability, and the whole text is read: the state is carried from window to window to its end.

Training: all training documents are dealt to as many trainers as their number asks for, half of them in each of
two rounds; each trainer runs truncated backpropagation over windows from the same start, and the trainers' weights
are averaged. Nothing but weights reaches the driver. A `share` below 1 takes that share of the documents (by a
hash of the id), or all of them if the share is empty.

Counts of rare words reach documents by a join on the word; only a table of the `known` most frequent words, of
fixed size, is sent to executors.

Defined cases: null or empty text is the end token alone. Null ids hash like ''. Without training documents
N and V are 0, n_known is 0 and every word is rare. Rows that repeat an id are scored one by one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, remainder_of_id, require

F32 = np.float32


def exponentials(logits: np.ndarray, rows: np.ndarray, at: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of logits (in place), taken below the largest of a row unless they are known to be safe, and the logits of the targets."""
    if not safe:
        logits -= logits.max(1, keepdims=True)
    own = logits[rows, at]
    np.exp(logits, out=logits)
    return logits, own


class Gru:
    """Weights by name. Token 0 is the end, 1 a rare word; tokens of a class follow one another."""

    def __init__(self, counts: np.ndarray, hidden: int, per_class: int, seed: int = 11):
        self.v, self.h, self.per = len(counts), hidden, per_class
        self.classes = -(-self.v // per_class)
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[-2])).astype(F32)
        log = np.full(self.classes * per_class, -30.0)
        log[: self.v] = np.log(np.maximum(counts, 0.5))
        log = log.reshape(self.classes, per_class)
        total = np.logaddexp.reduce(log, 1)
        self.p = {
            "x": (0.3 * draw(self.v, 3 * hidden) * np.sqrt(self.v)).astype(F32),  # embedding times input weights, as one table
            "u": draw(hidden, 2 * hidden), "n": draw(hidden, hidden), "b": np.zeros(3 * hidden, F32),
            "cw": np.zeros((hidden, self.classes), F32), "cb": (total - np.logaddexp.reduce(total)).astype(F32),
            "ww": np.zeros((self.classes, hidden, per_class), F32), "wb": (log - total[:, None]).astype(F32),
        }

    def start(self, n: int) -> np.ndarray:
        return np.zeros((n, self.h), F32)

    def step(self, tokens: np.ndarray, h: np.ndarray) -> tuple:
        """The states after these inputs; an end (0) starts from nothing."""
        p, k = self.p, self.h
        if not tokens.all():
            h = h * (tokens != 0)[:, None]
        x = p["x"][tokens]
        x += p["b"]
        zr = h @ p["u"]
        zr += x[:, : 2 * k]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r = zr[:, :k], zr[:, k:]
        n = (r * h) @ p["n"]
        n += x[:, 2 * k :]
        np.tanh(n, out=n)
        return n + z * (h - n), z, r, n

    def heads(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights of the classes and of the words in each class, with the bias as one more row; whether no exponential of a
        logit can overflow and no sum of them vanish: states lie between -1 and 1."""
        p = self.p
        cw, ww = np.concatenate([p["cw"], p["cb"][None]]), np.concatenate([p["ww"], p["wb"][:, None]], 1)
        safe = True
        for w, b in ((p["cw"][None], p["cb"][None]), (p["ww"], p["wb"])):
            reach = np.abs(w).sum(1)
            safe = safe and bool((b + reach).max() < 80 and (b - reach).max(1).min() > -80)
        return cw, ww, safe

    def by_class(self, targets: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
        """The order that puts targets of a class side by side, where each class begins, and then their classes and places in them."""
        c = (targets // self.per).astype(np.uint16 if self.classes < 1 << 16 else np.int64)  # short integers are sorted by radix
        order = np.argsort(c, kind="stable")
        c = c[order].astype(np.int64)
        return order, np.searchsorted(c, np.arange(self.classes + 1)).tolist(), c, targets[order] - c * self.per

    def log_probabilities(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms, for rows of states and the tokens that follow them."""
        cw, ww, safe = self.heads()
        order, edges, c, y = self.by_class(targets)
        h1 = np.ones((len(h), self.h + 1), F32)
        h1[:, :-1] = h[order]
        found, rows = np.empty(len(h), F32), np.arange(len(h))
        for a in range(0, len(h), 2048):  # as much as a processor's cache holds
            e, at = exponentials(h1[a : a + 2048] @ cw, rows[: len(h1[a : a + 2048])], c[a : a + 2048], safe)
            found[a : a + 2048] = at - np.log(e @ np.ones(self.classes, F32))
        ones = np.ones(self.per, F32)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            for a in range(edges[k], edges[k + 1], 2048):
                z = min(a + 2048, edges[k + 1])
                e, at = exponentials(h1[a:z] @ ww[k], rows[: z - a], y[a:z], safe)
                found[a:z] += at - np.log(e @ ones)
        out = np.empty(len(h), F32)
        out[order] = found
        return out

    def window(self, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """One window (steps, batch) of truncated backpropagation: gradients, the state after it, the loss."""
        p, k = self.p, self.h
        kept, hs = [], np.empty((len(inputs) + 1, *h.shape), h.dtype)
        hs[0] = h
        for t in range(len(inputs)):
            hs[t + 1], z, r, n = self.step(inputs[t], hs[t])
            kept.append((z, r, n))
        flat = hs[1:].reshape(-1, k)
        y, m = targets.ravel(), mask.ravel().astype(F32)
        g = {}
        cw, ww, safe = self.heads()
        order, edges, c, y = self.by_class(y)
        h1 = np.ones((len(flat), k + 1), flat.dtype)
        h1[:, :-1] = flat[order]
        scale = (m / max(m.sum(), 1))[order]
        rows = np.arange(len(y))
        e, at = exponentials(h1 @ cw, rows, c, safe)
        s = e @ np.ones(self.classes, F32)
        loss = -float(((at - np.log(s)) * scale).sum())
        e *= (scale / s)[:, None]
        e[rows, c] -= scale
        d = h1.T @ e
        g["cw"], g["cb"] = d[:-1], d[-1]
        to_states = e @ p["cw"].T
        both, ones = np.zeros_like(ww), np.ones(self.per, F32)
        for i in np.flatnonzero(np.diff(edges)).tolist():
            one = slice(edges[i], edges[i + 1])
            mine = rows[: edges[i + 1] - edges[i]]
            e, at = exponentials(h1[one] @ ww[i], mine, y[one], safe)
            s = e @ ones
            loss -= float(((at - np.log(s)) * scale[one]).sum())
            e *= (scale[one] / s)[:, None]
            e[mine, y[one]] -= scale[one]
            both[i] = h1[one].T @ e
            to_states[one] += e @ p["ww"][i].T
        g["ww"], g["wb"] = both[:, :-1], both[:, -1]
        dflat = np.empty_like(to_states)
        dflat[order] = to_states
        dflat = dflat.reshape(len(inputs), -1, k)
        # what no later step changes is worked out for the whole window, sums over steps are one product
        goes_on = (inputs != 0)[:, :, None]
        z, r, n = (np.stack(x) for x in zip(*kept))
        old = hs[:-1] * goes_on
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (old - n) * z * (1 - z), old * r * (1 - r)
        dh, dx = np.zeros_like(h), np.empty((len(inputs), len(h), 3 * k), dflat.dtype)
        back_n, back_u = p["n"].T.copy(), p["u"].T.copy()
        for t in range(len(inputs) - 1, -1, -1):
            dh += dflat[t]
            dn = np.multiply(dh, to_n[t], out=dx[t, :, 2 * k :])
            drh = dn @ back_n
            np.multiply(dh, to_z[t], out=dx[t, :, :k])
            np.multiply(drh, to_r[t], out=dx[t, :, k : 2 * k])
            drh *= r[t]
            dh *= z[t]
            dh += drh
            dh += dx[t, :, : 2 * k] @ back_u
            dh *= goes_on[t]
        dx = dx.reshape(-1, 3 * k)
        g["n"] = (r * old).reshape(-1, k).T @ dx[:, 2 * k :]
        g["u"] = old.reshape(-1, k).T @ dx[:, : 2 * k]
        g["b"] = dx.sum(0)
        x = inputs.ravel()
        by = np.argsort(x.astype(np.uint16) if self.v < 1 << 16 else x, kind="stable")
        first = np.flatnonzero(np.diff(x[by], prepend=-1))
        g["x"] = (x[by][first], np.add.reduceat(dx[by], first, 0))  # of the words that occur
        return g, hs[-1].copy(), float(loss)

    def train(self, docs: list[np.ndarray], steps: int = 20, batch: int = 256, rate: float = 0.01, memory: dict | None = None) -> None:
        """Lanes of documents, one after the other; the state is carried from window to window and starts anew with a document.
        memory: keeps the moments of the steps from one call to the next. Moments of a word's inputs change when it occurs."""
        if not docs:
            return
        memory = {} if memory is None else memory
        stream = np.concatenate(docs)
        lanes = max(1, min(batch, len(stream) // (8 * steps) or 1))
        length = -(-len(stream) // lanes)
        full = np.zeros((lanes, length), np.int64)
        mask = np.zeros((lanes, length), bool)
        full.ravel()[: len(stream)] = stream
        mask.ravel()[: len(stream)] = True
        before = np.concatenate([np.zeros((lanes, 1), np.int64), full[:, :-1]], 1)
        if not memory:
            memory |= {"m": {n: np.zeros_like(w) for n, w in self.p.items()}, "u": {n: np.zeros_like(w) for n, w in self.p.items()}, "t": 0}
        m, u, h = memory["m"], memory["u"], self.start(lanes)
        for a in range(0, length, steps):
            i, y, k = before[:, a : a + steps].T, full[:, a : a + steps].T, mask[:, a : a + steps].T
            g, h, _ = self.window(i, y, k, h)
            memory["t"] = t = memory["t"] + 1
            norm = np.sqrt(sum(float(np.vdot(x, x)) for n, x in g.items() if n != "x") + float(np.vdot(g["x"][1], g["x"][1])))
            clip = float(min(1.0, 1.0 / (norm + 1e-9)))
            scale = (1 - 0.99**t) ** 0.5  # of the second moments, kept out of the arrays
            for n, w in self.p.items():
                rows, x = g[n] if n == "x" else (slice(None), g[n])
                first, second = m[n][rows], u[n][rows]
                first *= 0.9
                first += (0.1 * clip) * x
                x *= x
                second *= 0.99
                x *= 0.01 * clip * clip
                second += x
                if n == "x":
                    m[n][rows], u[n][rows] = first, second
                step = np.sqrt(second)
                step += 1e-6 * scale
                np.divide(first, step, out=step)
                step *= rate * scale / (1 - 0.9**t)
                w[rows] -= step

    def score(self, docs: list[np.ndarray], lanes: int = 512, steps: int = 32) -> np.ndarray:
        """The natural log-probability of every whole document; the state is carried over its windows. Lanes take up
        the next document as soon as theirs ends, so long documents don't hold the others up. Memory follows the number of tokens."""
        if not docs:
            return np.zeros(0)
        sizes = np.array([len(d) for d in docs], np.int64)
        lanes = min(lanes, len(docs))
        heap = [(0, k) for k in range(lanes)]
        lane_of, loads = np.zeros(len(docs), np.int64), np.zeros(lanes, np.int64)
        for i in np.argsort(-sizes, kind="stable").tolist():
            load, k = heapq.heappop(heap)
            lane_of[i] = k
            loads[k] = load + sizes[i]
            heapq.heappush(heap, (int(loads[k]), k))
        rank = np.empty(lanes, np.int64)
        rank[np.argsort(-loads, kind="stable")] = np.arange(lanes)
        order = np.argsort(rank[lane_of], kind="stable")  # documents lane by lane, the fullest lane first
        loads = -np.sort(-loads)
        tokens = np.concatenate([docs[i] for i in order.tolist()])
        starts = np.cumsum(loads) - loads
        found = np.empty(len(tokens), F32)
        h, last = self.start(lanes), np.zeros(lanes, np.int64)
        for a in range(0, int(loads[0]), steps):
            states, places = [], []
            for t in range(a, min(a + steps, int(loads[0]))):
                n = int(np.searchsorted(-loads, -t, side="left"))  # lanes that still have a token at t
                if n < len(h):
                    h, last = h[:n], last[:n]
                h = self.step(last, h)[0]
                at = starts[:n] + t
                last = tokens[at]
                states.append(h)
                places.append(at)
            places = np.concatenate(places)
            found[places] = self.log_probabilities(np.concatenate(states), tokens[places])
        out = np.zeros(len(docs))
        own = sizes[order]
        out[order] = np.add.reduceat(found.astype(np.float64), np.cumsum(own) - own)
        return out


def words_of(text: str | None) -> list[bytes]:
    """Words of one text as UTF-8: of bytes, lower() folds A-Z alone and split() cuts at just the six blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def words_of_column(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, as words_of gives them (no text is null), and where each text's begin, with the end as one more."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # cuts at just the six blanks; blanks at the ends of a text leave empty words
    words, edges = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = pc.cast(words, pa.binary())
    given = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(given.to_numpy(zero_copy_only=False))])
    return words.filter(given), before[edges]


def in_lots(batches: Iterator[pa.RecordBatch], size: int = 8 << 20, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in order, in lots of about `size` bytes of `text` or `rows` rows, whatever the batches' own size."""
    waiting: list[pa.RecordBatch] = []
    held = n = 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(b):
            done = int(ends[a - 1]) if a else 0
            z = min(int(np.searchsorted(ends, done + size - held)) + 1, a + rows - n, len(b))
            waiting.append(b.slice(a, z - a))
            held, n, a = held + int(ends[z - 1]) - done, n + z - a, z
            if held >= size or n >= rows:
                yield pa.concat_batches(waiting)
                waiting, held, n = [], 0, 0
    if waiting:
        yield pa.concat_batches(waiting)


def frequent_words(counts: DataFrame, known: int) -> tuple[list[tuple[bytes, int]], int]:
    """At most `known` words with their counts, most frequent first, and the least count whose words, and those of more, are all among them. Words
    of about equal counts are taken together or not at all, but where that leaves less than half of `known`, they are taken by count and word. Found by a histogram over classes of counts, so executors send only these."""
    step = 64.0
    level = F.floor(F.log2("c") * step)
    sizes = {r[0]: (r[1], r[2]) for r in counts.groupBy(level.alias("l")).agg(F.count("*"), F.min("c")).collect()}  # at most 64 a doubling
    levels, least, total, fit = sorted(sizes, reverse=True), 1 << 62, 0, 0
    while fit < len(levels) and total + sizes[levels[fit]][0] <= known:
        total, least, fit = total + sizes[levels[fit]][0], sizes[levels[fit]][1], fit + 1
    taken = counts.where(F.col("c") >= least)
    if fit < len(levels) and 2 * total < known:
        taken = taken.unionByName(counts.where(level == levels[fit]).orderBy(F.desc("c"), "w").limit(known - total))
    rows = [(r.w.encode("utf-8", "surrogatepass"), r.c) for r in taken.collect()]
    return sorted(rows, key=lambda x: (-x[1], x[0])), least


def _counts(training: DataFrame, distinct: int = 400_000) -> DataFrame:
    """(w, c): every word and its count. Workers add up runs of documents before the shuffle, sending on what they have at `distinct` words."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Table] = []

        def whole() -> pa.Table:
            sums = pa.concat_tables(found).group_by("w", use_threads=False).aggregate([("c", "sum")])
            return pa.table({"w": sums["w"], "c": sums["c_sum"]})

        for b in in_lots(batches):
            words, _ = words_of_column(b.column("text"))
            one = pc.value_counts(words)
            found.append(pa.table({"w": one.field("values"), "c": one.field("counts")}))
            if sum(map(len, found)) >= 2 * distinct:
                found = [whole()]
                if len(found[0]) >= distinct:
                    yield from found[0].cast(sent).to_batches()
                    found = []
        if found:
            yield from whole().cast(sent).to_batches()

    sent = pa.schema([("w", pa.string()), ("c", pa.int64())])
    return training.select("text").mapInArrow(add_up, "w string, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _average(weights: DataFrame) -> list[np.ndarray] | None:
    """Means of (part, n, data): in groups of 16 on executors until at most 16 rows are left."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].sum()
        data = sum(np.frombuffer(d, F32) * F32(k / n) for d, k in zip(pdf["data"], pdf["n"]))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // 16], "n": [n], "data": [data.tobytes()]})

    rows = weights.count()
    while rows > 16:
        weights = materialize(weights.groupBy(F.floor(F.col("part") / 16)).applyInPandas(mean, "part long, n long, data binary"), "lm-mean")
        rows = weights.count()
    got = sorted(weights.collect())
    total = sum(r.n for r in got)
    return sum(np.frombuffer(r.data, F32) * F32(r.n / total) for r in got) if total else None


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 7, held_out: int = 2, head: int = 3072, known: int = 131_072,
    hidden: int = 16, per_class: int = 64, share: float = 1.0, docs_per_trainer: int = 6000, rounds: int = 2,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    ids = column(docs, id_col).cast("long")
    rows = docs.select(ids.alias("doc_id"), (remainder_of_id(ids, held_out_mod) == held_out).alias("held_out"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = materialize(_counts(training), "lm-counts")
    ends = training.count()
    n_words, v_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, v_all = n_words + ends, v_words + (ends > 0)
    top, least = frequent_words(counts, known)
    places = pa.array([w for w, _ in top], pa.binary())
    in_head = pa.array([w for w, _ in top[: max(head - 2, 0)]], pa.binary())
    logs = np.log10(np.array([c for _, c in top] + [0], np.float64) + 1)  # the last one stands for place -1
    in_model = min(head - 2, len(top))
    rare_tokens, rare_words = n_words - sum(c for _, c in top[:in_model]), v_words - in_model
    model = Gru(np.array([max(ends, 1), max(rare_tokens, 1)] + [c for _, c in top[:in_model]], float), hidden, per_class)
    names = list(model.p)

    def look_up(table: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Tokens of texts, one text after the other with its end, where each text begins, the places in the table (-1: none, ends too), and the words."""
        words, edges = words_of_column(texts)
        at = pc.fill_null(pc.index_in(words, value_set=table), -1).to_numpy()
        at = np.insert(at, edges[1:], -1)
        tokens = np.where((at >= 0) & (at < in_model), at + 2, 1).astype(np.int32)
        starts = edges + np.arange(len(edges))
        tokens[starts[1:] - 1] = 0
        return tokens, starts, at, words

    def load(flat: np.ndarray) -> Gru:
        at, out = 0, Gru.__new__(Gru)
        out.__dict__.update(model.__dict__)
        out.p = {}
        for name in names:
            w = model.p[name]
            out.p[name] = flat[at : at + w.size].reshape(w.shape).copy()
            at += w.size
        return out

    flat = np.concatenate([model.p[n].ravel() for n in names])
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    # rows equal in id and text are dealt to several trainers
    every = training.select("text", F.xxhash64("doc_id", "text").alias("k"), F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"))
    sample, n_sample = every, ends
    if share < 1:
        sample = materialize(training.where(draw < share).select("text", F.xxhash64("doc_id", "text").alias("k"), F.lit(0).alias("salt")), "lm-sample")
        n_sample = sample.count()
        if not n_sample:
            sample, n_sample = every, ends
    for turn in range(rounds):
        trainers = max(1, -(-n_sample // (docs_per_trainer * rounds)))
        mine = sample.where(F.pmod(F.xxhash64("k", F.lit(23)), F.lit(rounds)) == turn).repartition(trainers, "k", "salt").sortWithinPartitions("k").select("text", F.spark_partition_id().alias("part"))
        given = flat

        def learn(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            net, lists, memory, part, waiting, learned = load(given), [], {}, 0, 0, 0
            for b in in_lots(batches):
                part = b.column("part")[0].as_py()
                tokens, starts, _, _ = look_up(in_head, b.column("text"))  # words outside the model are rare, counted or not
                for one in np.split(tokens, starts[1:-1]):
                    lists.append(one)
                    waiting += len(one)
                    if waiting > 1_000_000:  # memory follows tokens, not documents
                        net.train(lists, memory=memory)
                        learned, waiting, lists = learned + waiting, 0, []
            net.train(lists, memory=memory)
            if learned + waiting:
                data = np.concatenate([net.p[n].ravel() for n in names]).tobytes()
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n": pa.array([learned + waiting], pa.int64()), "data": pa.array([data], pa.binary())})

        flat = _average(materialize(mine.mapInArrow(learn, "part long, n long, data binary"), "lm-weights"))
        flat = given if flat is None else flat
    trained = flat

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = load(trained)
        for b in in_lots(batches):
            tokens, starts, at, words = look_up(places, b.column("text"))
            log_c, first = logs[at], starts[:-1]
            add = lambda x, first=first: np.add.reduceat(x, first)
            n, known = np.diff(starts), add((at >= 0).astype(np.int64))
            rare = words.filter(pa.array(np.delete(at, starts[1:] - 1) < 0))
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n - 1 - known)]), pa.int32()), pc.cast(rare, pa.string()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "n": n, "n_head": add((tokens != 1).astype(np.int64)) - 1, "known": known,
                "log_c": add(log_c), "log_rare": add(np.where(tokens == 1, log_c, 0.0)), "rare": rare, "ln": net.score(np.split(tokens, first[1:])),
            })

    schema = "doc_id long, held_out boolean, n long, n_head long, known long, log_c double, log_rare double, rare array<string>, ln double"
    scored = rows.mapInArrow(score, schema).withColumn("row", F.struct(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    scored = materialize(scored.withColumn("row", F.col("row.m")), "lm-scored")
    # words outside the table: their counts come by a join, and go back as sums per row
    rare = scored.select("row", F.explode("rare").alias("w"))
    rare = rare.join(counts.where(F.col("c") < least), "w")
    sums = rare.groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 1)).alias("more_log"))
    out = scored.drop("rare").join(sums, "row", "left").na.fill({"more_known": 0, "more_log": 0.0})
    end_log = float(np.log10(ends + 1))
    rare_total = float(np.log10(rare_tokens + rare_words + 1)) if rare_tokens + rare_words else 0.0
    base = F.col("log_c") + F.col("more_log") + F.lit(end_log) - F.col("n") * float(np.log10(n_all + v_all + 1))
    whole = F.col("ln") / float(np.log(10)) + F.col("log_rare") + F.col("more_log") - (F.col("n") - 1 - F.col("n_head")) * rare_total
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.col("more_known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score"),
    )
