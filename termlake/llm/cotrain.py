"""Quality classifier by co-training on two views of a document.

The text view sees the words (hashed to `bins` columns), the metadata view the language, the
source and the size. Each has a logistic regression. In every round each model labels the
unlabelled documents it is surest of, and the other learns from these as from real labels. At the
end both are calibrated (Platt) on labelled documents that no model learned from, and the two
log-odds are added, each weighted by how well it does there.

Labelled rows to fit on are a bounded sample, as a documented parameter: `max_labelled`, those with
the smallest hash of doc_id, as vectors made on the executors. Unlabelled rows are not bounded: in
every round the executors score all of them, the surest are those beyond quantiles over the whole
corpus (`take` of it more in each round), and the executors add up these rows' losses and
gradients. Every row of the corpus is scored.

Defined cases: null and empty texts are a zero vector; null metadata is a value of its own; a
null doc_id is scored like any other row but never sampled; without both kinds of labels every
score is the share of good labels (0.5 without any); repeated rows are scored alike.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORDS, U64, WordHasher, chunks, columns, materialize, mix64, utf8

META_BINS = 256


def text_view(data: np.ndarray, off: np.ndarray, hasher: WordHasher, bins: int) -> np.ndarray:
    """Log counts of the words of each text by column, scaled to unit length, and three shares of characters."""
    h, _, _, first = hasher(data, off)
    n = len(off) - 1
    column = (h >> U64(40)).astype(np.int64) % bins
    row = np.repeat(np.arange(n), np.diff(first))
    x = np.log1p(np.bincount(row * bins + column, minlength=n * bins).reshape(n, bins)).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    raw = data[off[0] : off[-1]]
    size = np.maximum(np.diff(off), 1).astype(np.float32)
    share = lambda hit: (np.add.reduceat(np.append(hit, 0).astype(np.float32), off[:-1] - off[0]) * (np.diff(off) > 0) / size)[:, None]
    signs = np.zeros(256, bool)
    signs[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
    return np.hstack([x, 4 * share(signs[raw]), 4 * share((raw >= 65) & (raw <= 90)), 4 * share(raw == 10)])


def meta_view(langs: list, sources: list, sizes: np.ndarray) -> np.ndarray:
    x = np.zeros((len(langs), META_BINS), np.float32)
    for k, (lang, source) in enumerate(zip(langs, sources, strict=True)):
        for name, value in (("lang", lang), ("source", source), ("both", (lang, source))):
            x[k, zlib.crc32(f"{name}={value}".encode()) % (META_BINS - 16)] = 1
    step = np.minimum(15, np.log2(np.maximum(sizes, 1)).astype(int))
    x[np.arange(len(x)), META_BINS - 16 + step] = 1
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, rounds: int = 120) -> np.ndarray:
    """Weights (the last is the intercept) by Nesterov's gradient steps of the largest safe length."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    u = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        u = x.T @ (weight * (x @ u))
        curve = float(np.linalg.norm(u))
        u /= max(curve, 1e-12)
    step = 1 / (0.3 * curve + ridge)
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-(x @ v)))
        g = x.T @ (weight * (p - y)) + np.float32(ridge) * np.append(v[:-1], np.float32(0))
        new = v - np.float32(step) * g
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(np.float32) + w[-1]


def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return fit_logistic(z[:, None] / 4, y, np.ones(len(y)), 0.01, 400)


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic loss of rows and its gradient; the last weight is the intercept."""
    z = logit(x, w).astype(np.float64)
    off = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y).astype(np.float32)
    return float(np.sum(np.logaddexp(0, z) - y * z)), np.append(x.T @ off, off.sum()).astype(np.float64)


def minimise(evaluate, w: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halved steps; evaluate(w) gives value and gradient."""
    f, g = evaluate(w)
    past: list = []
    for _ in range(rounds):
        d, alphas = g.copy(), []
        for s, y in reversed(past):
            alphas.append((s @ d) / (s @ y))
            d -= alphas[-1] * y
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        step, slope = 1.0, float(d @ g)
        for _ in range(8):
            new = w - step * d
            f_new, g_new = evaluate(new)
            if f_new <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            return w
        s, y = new - w, g_new - g
        if s @ y > 1e-10:
            past = [*past, (s, y)][-memory:]
        done = f - f_new < 1e-5 * max(1.0, abs(f))
        w, f, g = new, f_new, g_new
        if done:
            break
    return w


def pick(z: np.ndarray, ids: np.ndarray, bounds: tuple) -> np.ndarray:
    """1 and 0 for rows among the surest, by their bin and, in the last bin, by a hash of doc_id; NaN for others."""
    top, top_part, low, low_part = bounds
    chance = (mix64(ids.astype(U64) + U64(1)) >> U64(11)).astype(np.float64) / (1 << 53)
    k = bins_of(z)
    good = (z > 0) & ((k > top) | ((k == top) & (chance < top_part)))
    bad = (z < 0) & ((k < low) | ((k == low) & (chance < low_part)))
    return np.where(good, 1.0, np.where(bad, 0.0, np.nan))


def bins_of(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -30, 30) * 64).astype(np.int64)


def surest(histogram: dict[int, int], n_good: float, n_bad: float) -> tuple:
    """For pick(): the bins where the best n_good and the worst n_bad rows end, and the parts of these bins that belong to them."""
    out = []
    for keys, n in ((sorted(histogram, reverse=True), n_good), (sorted(histogram), n_bad)):
        edge, part = keys[0] if keys else 0, 0.0
        for k in keys:
            edge, part = k, min(1.0, n / histogram[k])
            n -= histogram[k]
            if n <= 0:
                break
        out += [edge, part]
    return tuple(out)


def calibrate(model: dict, views: dict, y: np.ndarray) -> dict:
    """Calibrations and shares of both views on the held labelled rows."""
    out = {"model": model, "platt": {}, "share": {}}
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    worst = -(base * np.log(base) + (1 - base) * np.log(1 - base))
    for v, x in views.items():
        z = logit(x, model[v])
        out["platt"][v] = c = _platt(z, y)
        p = np.clip(1 / (1 + np.exp(-(z / 4 * c[0] + c[1]))), 1e-6, 1 - 1e-6)
        loss = -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        out["share"][v] = max(0.0, 1 - loss / worst)
    out["prior"] = float(np.log(base / (1 - base)))
    return out


def exchange(rows: DataFrame, labels: DataFrame, views, model: dict, part: float, share: float) -> tuple[DataFrame, dict]:
    """Both views of the unlabelled documents that either model is surest of, as vectors, with the labels from the other view.

    Two passes over all rows: the first counts scores by bin, the second keeps what stands beyond the quantiles.
    """

    def logits(batches):
        hasher = WordHasher(SPACE_WORDS)
        for batch in batches:
            for ids, x, m in views(batch, hasher):
                yield np.asarray(ids, np.int64), x, m, logit(x, model["text"]), logit(m, model["meta"])

    def binned(batches):
        for ids, _, _, t, m in logits(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, bins_of(t), bins_of(m))], ["doc_id", "text", "meta"])

    scored = rows.mapInArrow(binned, "doc_id long, text long, meta long").join(labels.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"])
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("bin")) for v in ("text", "meta")])).alias("p")
    counts: dict = {"text": {}, "meta": {}}
    for r in scored.select(pairs).groupBy("p.view", "p.bin").count().collect():  # 4,000 bins a view at most
        counts[r["view"]][r["bin"]] = r["count"]
    bounds = {v: surest(h, part * share * sum(h.values()), part * (1 - share) * sum(h.values())) for v, h in counts.items()}

    def kept(batches):
        for ids, x, m, t, z in logits(batches):
            by_text, by_meta = pick(t, ids, bounds["text"]), pick(z, ids, bounds["meta"])
            i = np.flatnonzero(~np.isnan(by_text) | ~np.isnan(by_meta))
            vectors = [pa.array([v.astype(np.float16).tobytes() for v in part_[i]], pa.binary()) for part_ in (x, m)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), *vectors, pa.array(by_meta[i]), pa.array(by_text[i])], ["doc_id", "text", "meta", "for_text", "for_meta"])

    found = rows.mapInArrow(kept, "doc_id long, text binary, meta binary, for_text double, for_meta double")
    chosen = materialize(found.join(labels.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"]), "exchange")
    n = chosen.agg(*[F.count_if(~F.isnan(f"for_{v}")).alias(v) for v in ("text", "meta")]).first()
    return chosen, n.asDict()


def fit_with(chosen: DataFrame, n: dict, learn: dict, y: np.ndarray, model: dict, grid, widths: dict, ridge: float = 0.3, rounds: int = 25) -> dict:
    """Both models from labelled rows and pseudo-labels, whose losses and gradients the executors add up.

    A pseudo-label weighs half a label, and all of a view's together half of its labels, so that many don't drown these.
    """
    weight = {v: min(0.5, 0.5 * len(y) / max(1, n[v])) for v in widths}
    cut = widths["text"] + 1

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        parts = {"text": w[:cut], "meta": w[cut:]}

        def sums(batches):
            total, loss = {v: np.zeros(k + 1) for v, k in widths.items()}, 0.0
            for batch in batches:
                for v in widths:
                    x, label = columns(batch, v, f"for_{v}")
                    label = np.asarray(label)
                    i = np.flatnonzero(~np.isnan(label))
                    f, g = _loss(grid(x.take(pa.array(i)).to_pylist(), widths[v]), label[i], parts[v])
                    total[v] += weight[v] * g
                    loss += weight[v] * f
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([np.concatenate([total["text"], total["meta"]]).tobytes()], pa.binary())], ["loss", "gradient"])

        f, g = 0.0, np.zeros(len(w))
        for r in chosen.mapInArrow(sums, "loss double, gradient binary").collect():  # a row per task
            f, g = f + r["loss"], g + np.frombuffer(r["gradient"])
        for v, x in learn.items():
            own, at = parts[v], slice(0, cut) if v == "text" else slice(cut, None)
            f_, g_ = _loss(x, y, own)
            pull = np.append(own[:-1], 0.0)
            f, g[at] = f + f_ + ridge / 2 * float(pull @ pull), g[at] + g_ + ridge * pull
        return f, g

    w = minimise(evaluate, np.concatenate([model["text"], model["meta"]]).astype(np.float64), rounds)
    return {"text": w[:cut], "meta": w[cut:]}


def quality_scores(docs: DataFrame, labels: DataFrame, bins: int = 1024, rounds: int = 3, take: float = 0.05, max_labelled: int = 4000, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept for every row of docs(doc_id, text, lang, source)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))

    def views(batch, hasher):
        ids, texts, langs, sources = columns(batch, "doc_id", "text", "lang", "source")
        data, off = utf8(texts)
        for a, b in chunks(off):
            yield ids.slice(a, b - a), text_view(data, off[a : b + 1], hasher, bins), meta_view(langs.slice(a, b - a).to_pylist(), sources.slice(a, b - a).to_pylist(), np.diff(off[a : b + 1]))

    def vectors(batches):
        hasher = WordHasher(SPACE_WORDS)
        for batch in batches:
            labels_ = columns(batch, "good")[0]
            at = 0
            for ids, x, m in views(batch, hasher):
                n = len(ids)
                yield pa.RecordBatch.from_arrays([ids, labels_.slice(at, n), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), pa.array([r.astype(np.float16).tobytes() for r in m], pa.binary())], ["doc_id", "good", "text", "meta"])
                at += n

    good = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0.0)).alias("good"))
    order = F.xxhash64("doc_id", F.lit(4))
    ids = slim.filter("doc_id is not null").select("doc_id").distinct()
    labelled = ids.join(good.filter("good is not null"), "doc_id").orderBy(order, "doc_id").limit(max_labelled)
    sample = slim.join(F.broadcast(labelled), "doc_id").dropDuplicates(["doc_id"]).mapInArrow(vectors, "doc_id long, good double, text binary, meta binary").orderBy("doc_id").collect()
    grid = lambda column, n: np.frombuffer(b"".join(column), np.float16).astype(np.float32).reshape(len(column), n)
    widths = {"text": bins + 3, "meta": META_BINS}
    y = np.array([r["good"] for r in sample])
    held = np.arange(len(y)) % 4 == 3
    fitted, share = None, float(y.mean()) if len(y) else 0.5
    if len(y) >= 8 and 0 < share < 1 and 0 < y[held].mean() < 1 and 0 < y[~held].mean() < 1:
        known = {v: grid([r[v] for r in sample], n) for v, n in widths.items()}
        learn = {v: x[~held] for v, x in known.items()}
        model = {v: fit_logistic(x, y[~held], np.ones(len(x))) for v, x in learn.items()}
        for r in range(rounds):
            chosen, n = exchange(slim.filter("doc_id is not null"), good, views, dict(model), take * (r + 1), float(y[~held].mean()))
            if not sum(n.values()):
                break
            model = fit_with(chosen, n, learn, y[~held], model, grid, widths)
        fitted = calibrate(model, {v: x[held] for v, x in known.items()}, y[held])

    def score(batches):
        hasher = WordHasher(SPACE_WORDS)
        for batch in batches:
            for ids, x, m in views(batch, hasher):
                if fitted is None:
                    t = z = s = np.full(len(ids), share)
                else:
                    own = {}
                    total = np.full(len(ids), fitted["prior"])
                    for v, part in (("text", x), ("meta", m)):
                        c = fitted["platt"][v]
                        raw = logit(part.astype(np.float32), fitted["model"][v]) / 4 * c[0] + c[1]
                        own[v] = 1 / (1 + np.exp(-raw))
                        total += fitted["share"][v] ** 0.5 * (raw - fitted["prior"])
                    t, z, s = own["text"], own["meta"], 1 / (1 + np.exp(-total))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.asarray(c, np.float64)) for c in (t, z, s)), pa.array(np.asarray(s) >= threshold)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return slim.mapInArrow(score, "doc_id long, text_score double, meta_score double, score double, kept boolean")
