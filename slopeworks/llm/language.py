"""Language of documents by a bidirectional gated recurrent network over bytes, trained in numpy.

Every byte gets probabilities from the states of both directions; a document's are the mean over its bytes. A text is read in
windows: each labels its inner bytes and reads some more on either side to warm up, so texts of any length need the same
memory. The network is fitted by backpropagation through time on a bounded sample of labelled texts (SAMPLE for each
language); prediction reads every byte of every text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.llm.tasks import released

SAMPLE = 300  # labelled documents for each language that the network is fitted on
SAMPLE_CHARS = 600  # of each, from a place that the hash of the doc_id fixes
LANGUAGES = 200  # most that are told apart: those with the most labelled documents
HIDDEN = 8
INNER, WARM = 224, 16
LANES = 2048
STEPS, BATCH, SPAN = 260, 192, 48
UNKNOWN = "und"
_MAYBE_LETTER = re.compile(r"[^\W\d_]")  # and signs such as a half or a Roman numeral, which are no letters


class ByteNetwork:
    """Two gated recurrent units, one for each direction, and a softmax over both states. Byte 0 stands outside of a text."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7):
        import numpy as np

        self.classes, self.hidden, self.left_out = classes, hidden, 0
        r = np.random.default_rng(seed)
        h, k = hidden, len(classes)
        self.weights = {}
        for d in "fb":
            self.weights |= {f"x{d}": r.normal(0, 0.3, (256, 3 * h)), f"u{d}": r.normal(0, 1 / np.sqrt(h), (h, 3 * h)), f"o{d}": r.normal(0, 1 / np.sqrt(h), (h, k))}
        self.weights["bias"] = np.zeros(k)
        self.weights = {n: w.astype(np.float32) for n, w in self.weights.items()}

    def _step(self, x, state, u):
        """Next state, and what the gradient needs: both gates, the candidate and its recurrent part."""
        import numpy as np

        h = self.hidden
        pre = state @ u
        gates = pre[:, :2 * h]
        gates += x[:, :2 * h]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        inner = pre[:, 2 * h:]
        cand = gates[:, :h] * inner
        cand += x[:, 2 * h:]
        np.tanh(cand, out=cand)
        new = state - cand
        new *= gates[:, h:]
        new += cand
        return new, gates, cand, inner

    def _direction(self, d: str, codes, order):
        """The states of one direction, step by step. Each gate has arrays of its own, so that numpy works on whole blocks;
        the sigmoids are taken from tanh of half the sum, with the halves put into the weights."""
        import numpy as np

        h, (_, lanes) = self.hidden, codes.shape
        x, u = self.weights[f"x{d}"], self.weights[f"u{d}"]
        tables = [np.ascontiguousarray(x[:, k * h:(k + 1) * h] * (0.5 if k < 2 else 1)) for k in range(3)]
        mixes = [np.ascontiguousarray(u[:, k * h:(k + 1) * h] * (0.5 if k < 2 else 1)) for k in range(3)]
        state = np.zeros((lanes, h), np.float32)
        r, z, c, seen = (np.empty((lanes, h), np.float32) for _ in range(4))
        for t in order:
            now = codes[t]
            for gate, k in ((r, 0), (z, 1)):
                np.matmul(state, mixes[k], out=gate)
                gate += tables[k].take(now, axis=0, out=seen, mode="clip")
                np.tanh(gate, out=gate)
                gate += 1
                gate *= 0.5
            np.matmul(state, mixes[2], out=c)
            c *= r
            c += tables[2].take(now, axis=0, out=seen, mode="clip")
            np.tanh(c, out=c)
            state -= c
            state *= z
            state += c
            yield t, state

    def label(self, codes, counted):
        """Sums of probabilities over the counted bytes, for codes and counted of shape (time, lanes)."""
        import numpy as np

        w, (time, lanes), k = self.weights, codes.shape, len(self.classes)
        scores = np.empty((time, lanes, k), np.float32)
        for t, state in self._direction("b", codes, range(time - 1, -1, -1)):
            np.matmul(state, w["ob"], out=scores[t])
        for t, state in self._direction("f", codes, range(time)):
            scores[t] += state @ w["of"]
        scores += w["bias"]
        np.exp(scores, out=scores)
        scores *= (counted / (scores @ np.ones(k, np.float32)))[:, :, None]
        return scores.sum(axis=0)

    def gradients(self, codes, target, counted):
        """Cross-entropy by byte and its gradients, through all steps of both directions."""
        import numpy as np

        w, h, (time, lanes) = self.weights, self.hidden, codes.shape
        kept, states = {}, {}
        for d, order in (("f", range(time)), ("b", range(time - 1, -1, -1))):
            state = np.zeros((lanes, h), np.float32)
            for t in order:
                new, gates, cand, inner = self._step(w[f"x{d}"][codes[t]], state, w[f"u{d}"])
                kept[d, t] = (state, gates, cand, inner)
                states[d, t] = state = new
        grads = {n: np.zeros_like(v) for n, v in w.items()}
        out, loss, scale = {}, 0.0, 1 / max(1.0, float(counted.sum()))
        for t in range(time):
            scores = states["f", t] @ w["of"] + states["b", t] @ w["ob"] + w["bias"]
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            rows = np.arange(lanes)
            loss -= float((np.log(p[rows, target] + 1e-9) * counted[t]).sum()) * scale
            p[rows, target] -= 1
            p *= counted[t][:, None] * scale
            out[t] = p
            grads["of"] += states["f", t].T @ p
            grads["ob"] += states["b", t].T @ p
            grads["bias"] += p.sum(axis=0)
        for d, order in (("f", range(time - 1, -1, -1)), ("b", range(time))):
            down = np.zeros((lanes, h), np.float32)
            u = w[f"u{d}"]
            for t in order:
                state, gates, cand, inner = kept[d, t]
                r, z = gates[:, :h], gates[:, h:]
                g = down + out[t] @ w[f"o{d}"].T
                g_cand = g * (1 - z) * (1 - cand * cand)
                g_z = g * (state - cand) * z * (1 - z)
                g_r = g_cand * inner * r * (1 - r)
                pre = np.concatenate([g_r, g_z, g_cand * r], axis=1)
                grads[f"u{d}"] += state.T @ pre
                down = g * z + pre @ u.T
                pre[:, 2 * h:] = g_cand
                np.add.at(grads[f"x{d}"], codes[t], pre)
        return loss, grads

    def fit(self, texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 11) -> ByteNetwork:
        """Adam on random spans of the texts, languages in equal shares."""
        import numpy as np

        r = np.random.default_rng(seed)
        place = {c: k for k, c in enumerate(self.classes)}
        by_class = [[t for t, v in zip(texts, labels) if place[v] == k] for k in range(len(self.classes))]
        first = {n: np.zeros_like(v) for n, v in self.weights.items()}
        second = {n: np.zeros_like(v) for n, v in self.weights.items()}
        for step in range(1, steps + 1):
            codes = np.zeros((SPAN, BATCH), np.uint8)
            target = r.integers(0, len(self.classes), BATCH)
            for lane, k in enumerate(target):
                text = by_class[k][r.integers(0, len(by_class[k]))]
                at = int(r.integers(-SPAN // 4, max(1, len(text) - SPAN // 2)))  # some spans reach over an end
                part = np.frombuffer(text[max(at, 0):at + SPAN], np.uint8)
                codes[max(-at, 0):max(-at, 0) + len(part), lane] = part
            _, grads = self.gradients(codes, target, (codes != 0).astype(np.float32))
            rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
            for n, g in grads.items():
                np.clip(g, -0.05, 0.05, out=g)
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.01 * (g * g - second[n])
                self.weights[n] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
        return self

    def probabilities(self, texts: list[bytes]):
        """Mean probabilities of each text over all its bytes; of an empty text all are 0."""
        import numpy as np

        span = INNER + 2 * WARM
        total = np.zeros((len(texts), len(self.classes)), np.float64)
        sizes = np.array([len(t) for t in texts], np.int64)
        windows = [(i, at) for i, n in enumerate(sizes.tolist()) for at in range(0, n, INNER)]
        windows.sort(key=lambda w: -min(int(sizes[w[0]]) - w[1], INNER))  # lanes of like length together
        for k in range(0, len(windows), LANES):
            part = windows[k:k + LANES]
            codes = np.zeros((len(part), span), np.uint8)
            inner = np.zeros((len(part), span), np.float32)
            for lane, (i, at) in enumerate(part):
                start = at - WARM
                piece = texts[i][max(start, 0):at + INNER + WARM]
                shift = max(-start, 0)
                codes[lane, shift:shift + len(piece)] = np.frombuffer(piece, np.uint8)
                inner[lane, WARM:WARM + min(INNER, int(sizes[i]) - at)] = 1
            used = int(np.flatnonzero(codes.any(axis=0)).max(initial=0)) + 1
            sums = self.label(np.ascontiguousarray(codes[:, :used].T), np.ascontiguousarray(inner[:, :used].T))
            np.add.at(total, np.array([i for i, _ in part]), sums)
        return total / np.maximum(sizes, 1)[:, None]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def held_out():
    """Documents whose doc_id has remainder 2 of crc32 by 4 are never learnt from."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, sample: int = SAMPLE) -> ByteNetwork | None:
    """Fits on up to `sample` texts of each language of `docs`, those of lowest hash; None if there is none to learn from.

    Labels beyond the `LANGUAGES` most frequent ones are not learnt; the network's `left_out` tells how many those are.
    """
    learn = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    by_lang = learn.groupBy("lang").count().persist()
    counts = {r["lang"]: r["count"] for r in by_lang.orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    left_out = by_lang.count() - len(counts)
    by_lang.unpersist()
    if not counts:
        return None
    # Twice the share that is wanted, then the lowest hashes of those, on Spark: what is collected has a fixed size.
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**62))
    limit = F.element_at(F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(2**62, 2**63 * sample // n))]), F.col("lang"))
    start = (F.pmod(F.xxhash64("doc_id"), F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(1)))).cast("int") + 1
    some = learn.filter(place < limit).select("lang", place.alias("place"), F.substr("text", start, F.lit(SAMPLE_CHARS)).alias("part")).distinct()
    order = F.row_number().over(Window.partitionBy("lang").orderBy("place", "part"))
    rows = some.withColumn("k", order).filter(F.col("k") <= sample).collect()
    kept: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"], r["part"])):
        kept.setdefault(r["lang"], []).append(r["part"].encode())
    pairs = [(t, lang) for lang, texts in kept.items() for t in texts]
    network = ByteNetwork(sorted(kept)).fit([t for t, _ in pairs], [v for _, v in pairs])
    network.left_out = left_out
    return network


def _predict_task(network: ByteNetwork | None):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                plain = list(map(has_letter, texts))
                found = network.probabilities([t.encode() for t, p in zip(texts, plain) if p]) if network and any(plain) else None
                langs, scores, at = [], [], 0
                for p in plain:
                    if p and found is not None:
                        langs.append(network.classes[int(found[at].argmax())])
                        scores.append(min(1.0, float(found[at].max())))
                        at += 1
                    else:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                columns = [c for c in part.schema.names if c not in ("lang_pred", "score")]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in columns], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])
    return run


def predict_language(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """Adds lang_pred and score (replacing columns of these names); only `text` is read.

    Null texts and texts without a letter are `und` with score 0, and so is all without a network. Repeated rows get the same.
    """
    rows = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", lang_pred string, score double"
    return rows.mapInArrow(released(_predict_task(network)), schema)
