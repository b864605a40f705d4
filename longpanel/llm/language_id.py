"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text is folded to lower-case letters and single spaces. Each language's model gives every letter a probability from
the three before it; the language of lowest cross-entropy, in bits a character, is chosen. A text is rejected when that
cross-entropy is above what texts of the language kept from training show at its length.

The models are fitted on a bounded sample: at most ``max_rows`` labelled rows and ``max_chars`` characters of each
language, lowest hash first (a language keeps its first text whole, however long). One sampled row in five calibrates
the rejection instead of being counted. N-grams are counted by Spark; the arrays of the model are bounded by the sample
and are broadcast. Labels with more than ``max_languages`` values raise an error.

Texts are scored whole, in their own partitions; nothing of them is shuffled. NULL texts and texts without a letter are
``und`` with score 0, and rejected. Without labelled rows every text is. Rows with a NULL label or key do not train.
Repeated rows and ties (the alphabetically first language wins) are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import releasing
from .scratch import stage
from .words import U, batches, mix

ORDER = 4
MAX_ROWS, MAX_CHARS, MAX_LANGUAGES = 1500, 2_000_000, 256
#: Rejection: the mean of calibration texts, plus so many of their deviations, so many of a mean of n characters', and bits.
TEXT_SD, CHAR_SD, SLACK = 4.0, 5.0, 1.5
_BASE = U(0x9E3779B97F4A7C15)
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a space."""
    if not _FOLD:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(t)
    return _FOLD[0]


def folded(texts: list[str], lead: int = ORDER - 1) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts, each led by ``lead`` spaces; and where each begins (one more at the end)."""
    gap = " " * lead
    codes = np.frombuffer("".join(gap + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.concatenate(([0], np.cumsum([len(t) + lead for t in texts]))).astype(np.int64)
    f = _fold_table()[codes]
    keep = (f != 32) | (np.concatenate(([0], f[:-1])) != 32)
    # the leading spaces of each text stay as they are
    for k in range(lead):
        keep[start[:-1] + k] = True
    return f[keep], np.concatenate(([0], np.cumsum(keep)))[start]


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = h * _BASE + (c.astype(np.uint64) + U(1))
    return mix(h)


class Hashes:
    """A sorted array of hashes, searched from where a hash would stand if they were evenly spread."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = U(64 - bits)
        edges = np.arange((1 << bits) + 1, dtype=np.uint64)
        self.first = np.searchsorted(keys >> self.shift, edges).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if absent."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        b = (h >> self.shift).astype(np.int64)
        at, end = self.first[b], self.first[b + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            k = self.keys[at[live]]
            hit = k == h[live]
            out[live[hit]] = at[live[hit]]
            at[live] += 1
            live = live[~hit & (at[live] < end[live])]
        return out


class Model:
    """Log2-probabilities of every language for the n-grams any of them has, by order, and back-off weights."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """``grams``: language -> (codes, one row for each distinct n-gram of the top order; their counts)."""
        self.languages = sorted(grams)
        n_lang = len(self.languages)
        symbols = {int(c) for g, _ in grams.values() for c in np.unique(g)}
        self.floor = float(-np.log2(len(symbols) + 1))
        # top-order counts, and below them the number of distinct characters that an n-gram follows
        level: dict[int, dict[str, tuple[np.ndarray, np.ndarray]]] = {ORDER: grams}
        for n in range(ORDER - 1, 0, -1):
            level[n] = {}
            for lang, (g, _) in level[n + 1].items():
                h, first, count = np.unique(_hash([g[:, j] for j in range(1, n + 1)]), return_index=True, return_counts=True)
                level[n][lang] = (g[first, 1:], count)
        self.tables: list[tuple[Hashes, np.ndarray, Hashes, np.ndarray]] = []
        below: tuple[Hashes, np.ndarray] | None = None
        for n in range(1, ORDER + 1):
            every = np.concatenate([level[n][lang][0] for lang in self.languages])
            keys, first = np.unique(_hash([every[:, j] for j in range(n)]), return_index=True)
            codes = every[first]
            context = _hash([codes[:, j] for j in range(n - 1)]) if n > 1 else np.zeros(len(codes), np.uint64)
            contexts = np.unique(context)
            if below is None:
                lower = np.full((len(keys), n_lang), 2.0 ** self.floor)
            else:
                lower = 2.0 ** below[1][below[0].find(_hash([codes[:, j] for j in range(1, n)]))].astype(np.float64)
            p, weight = lower.copy(), np.ones((len(contexts), n_lang))
            for k, lang in enumerate(self.languages):
                g, c = level[n][lang]
                once, twice = int((c == 1).sum()), int((c == 2).sum())
                d = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
                at = np.searchsorted(keys, _hash([g[:, j] for j in range(n)]))
                ctx = np.searchsorted(contexts, context[at])
                total = np.bincount(ctx, c, len(contexts))
                kinds = np.bincount(ctx, minlength=len(contexts))
                seen = total > 0
                weight[seen, k] = d * kinds[seen] / total[seen]
                own = np.zeros(len(keys))
                own[at] = c - d
                mine = np.searchsorted(contexts, context)
                p[:, k] = np.where(seen[mine], own / np.maximum(total[mine], 1) + weight[mine, k] * lower[:, k], lower[:, k])
            held = Hashes(keys)
            self.tables.append((held, np.log2(p).astype(np.float32), Hashes(contexts), np.log2(weight).astype(np.float32)))
            below = held, self.tables[-1][1]

    def logs(self, f: np.ndarray) -> np.ndarray:
        """Log2-probability of every character (from the ``ORDER``-th) under every language."""
        m = len(f) - ORDER + 1
        out = np.zeros((m, len(self.languages)), np.float32)
        left = np.arange(m)
        for n in range(ORDER, 0, -1):
            held, logp, contexts, weight = self.tables[n - 1]
            cols = [f[left + (ORDER - n + j)] for j in range(n)] if n < ORDER else [f[j:j + m] for j in range(n)]
            at = held.find(_hash(cols))
            hit = at >= 0
            if n == ORDER:
                out[hit] = logp[at[hit]]
            else:
                out[left[hit]] += logp[at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            ctx = (contexts.find(_hash([c[~hit] for c in cols[:-1]])) if n > 1 else np.zeros(len(left), np.int32))
            known = ctx >= 0
            out[left[known]] += weight[ctx[known]]
        out[left] += self.floor
        return out

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log2-likelihood of each text under each language, sums of squares alike, and its folded characters."""
        f, start = folded(texts)
        n = np.diff(start) - (ORDER - 1)
        logs = self.logs(f) if len(f) >= ORDER else np.zeros((0, len(self.languages)), np.float32)
        # a text's characters are the windows that begin in it and end in it
        total = np.zeros((len(logs) + 1, len(self.languages)))
        np.cumsum(logs, axis=0, dtype=np.float64, out=total[1:])
        square = np.zeros_like(total)
        np.cumsum(np.square(logs), axis=0, dtype=np.float64, out=square[1:])
        lo, hi = start[:-1], start[:-1] + n
        return total[hi] - total[lo], square[hi] - square[lo], n


def _has_letter(texts: list[str]) -> np.ndarray:
    return np.fromiter((any(c.isalpha() for c in t) for t in texts), bool, len(texts))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, key: str = "doc_id", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """``lang``, ``text``, ``calibrates`` of the bounded sample of labelled rows that are not held out."""
    usable = docs.where(F.col(key).isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col(key)))
    # a text gives at most a twentieth of the characters, so that one very long text does not end its language's sample
    usable = usable.select("lang", F.xxhash64(F.col(key), F.lit("sample")).alias("h"), F.substring("text", 1, max(1, max_chars // 20)).alias("text"))
    t = usable.select("lang", "h", F.length("text").alias("n"))
    # rows of a language are first cut within hashed parts of it, so that no task ranks them all
    part = Window.partitionBy("lang", F.pmod("h", F.lit(256))).orderBy("h")
    whole = Window.partitionBy("lang").orderBy("h")
    t = t.withColumn("k", F.row_number().over(part)).where(F.col("k") <= max(4, max_rows // 32))
    t = t.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= max_rows)
    t = t.withColumn("sum", F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    cut = t.where((F.col("k") == 1) | (F.col("sum") <= max_chars)).groupBy("lang").agg(F.max("h").alias("cut"), F.min("h").alias("least"))
    picked = usable.join(F.broadcast(cut), "lang").where(F.col("h") <= F.col("cut"))
    # the first rows of a language always count, so that none is left without a model
    fifth = (F.pmod(F.xxhash64("h", F.lit("calibrates")), F.lit(5)) == 0) & (F.col("h") > F.col("least"))
    return picked.select("lang", "text", fifth.alias("calibrates"))


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lang, part in frame.groupby("lang"):
            texts = list(part["text"])
            for a, b in batches([len(t) for t in texts], 1_000_000):
                f, start = folded(texts[a:b])
                keep = np.ones(len(f), bool)
                for k in range(ORDER - 1):
                    keep[start[1:] - 1 - k] = False
                at = np.flatnonzero(keep)
                rows, n = np.unique(np.stack([f[at + j] for j in range(ORDER)], 1), axis=0, return_counts=True)
                text = rows.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                yield pd.DataFrame({"lang": lang, "gram": [text[i * ORDER:(i + 1) * ORDER] for i in range(len(rows))], "n": n.astype("int64")})


def fit(docs: DataFrame, key: str = "doc_id", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS,
        max_languages: int = MAX_LANGUAGES) -> tuple[Model | None, np.ndarray]:
    """The model, and for each language (mean, deviation of texts, deviation of characters) of its calibration texts."""
    rows = stage(sample(docs, key, max_rows, max_chars).repartition(8), "language-sample")
    many = rows.select("lang").distinct().count()
    if many > max_languages:
        raise ValueError(f"{many} languages; at most {max_languages} are expected")
    counted = (rows.where(~F.col("calibrates")).mapInPandas(releasing(_count), "lang string, gram string, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    if counted.empty:
        return None, np.zeros((0, 3))
    grams = {}
    for lang, part in counted.groupby("lang"):
        codes = np.frombuffer("".join(part["gram"]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
        grams[lang] = (codes, part["n"].to_numpy())
    model = Model(grams)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for frame in frames:
            frame = frame[frame["lang"].isin(m.languages)].reset_index(drop=True)
            own = frame["lang"].map(m.languages.index).to_numpy(int) if len(frame) else np.zeros(0, int)
            for a, b in batches([len(t) for t in frame["text"]], 1_000_000):
                s, q, n = m.totals(list(frame["text"][a:b]))
                r = np.arange(b - a)
                yield pd.DataFrame({"lang": frame["lang"][a:b].to_numpy(), "s": -s[r, own[a:b]], "q": q[r, own[a:b]], "n": n})

    bits = F.col("s") / F.col("n")
    seen = {r["lang"]: r for r in rows.where("calibrates").mapInPandas(releasing(measure), "lang string, s double, q double, n long")
            .where("n >= 100").groupBy("lang").agg(
                F.avg(bits).alias("mean"), F.coalesce(F.stddev_pop(bits), F.lit(0.0)).alias("sd"),
                F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2))).alias("char")).collect()}
    # a language without calibration texts rejects nothing
    limits = np.array([[seen[x]["mean"], seen[x]["sd"], seen[x]["char"]] if x in seen else [np.inf, 0, 0] for x in model.languages])
    return model, limits


def judged(texts: list[str], model: Model | None, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, posterior probability, bits a character (NaN for ``und``) and acceptance of texts."""
    n_texts = len(texts)
    lang, score = np.full(n_texts, "und", object), np.zeros(n_texts)
    bits, fine = np.full(n_texts, np.nan), np.zeros(n_texts, bool)
    if model is not None:
        names = np.array(model.languages, object)
        rows = np.flatnonzero(_has_letter(texts))
        for a, b in batches([len(texts[i]) for i in rows], 250_000):
            part = rows[a:b]
            s, _, n = model.totals([texts[i] for i in part])
            best = s.argmax(1)
            top = s[np.arange(len(part)), best]
            lang[part], bits[part] = names[best], -top / n
            score[part] = 1.0 / np.exp2(np.maximum(s - top[:, None], -1000.0)).sum(1)
            lim = limits[best]
            fine[part] = bits[part] <= lim[:, 0] + TEXT_SD * lim[:, 1] + CHAR_SD * lim[:, 2] / np.sqrt(n) + SLACK
    return lang, score, bits, fine


def identify(docs: DataFrame, model: Model | None, limits: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` (posterior probability), ``bits`` (cross-entropy) and ``accepted`` of every row."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, lang_pred string, score double, bits double, accepted boolean"
    shared = docs.sparkSession.sparkContext.broadcast((model, limits))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, limit = shared.value
        for frame in frames:
            lang, posterior, bits, fine = judged([t if isinstance(t, str) else "" for t in frame["text"]], m, limit)
            yield pd.DataFrame({key: frame["key"], "lang_pred": lang, "score": posterior, "bits": bits, "accepted": fine})

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(releasing(score), schema)


def accepted(docs: DataFrame, model: Model | None, limits: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`identify` rejects; all columns are kept as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model, limits))

    def keep(frames: Iterator) -> Iterator:
        import pyarrow as pa

        m, limit = shared.value
        for batch in frames:
            for at in range(0, batch.num_rows, 500):
                few = batch.slice(at, 500)
                fine = judged([t or "" for t in few.column(text).to_pylist()], m, limit)[3]
                yield few.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(releasing(keep), docs.schema)
