"""Quality rules: statistics of whole texts and a learned decision list over them.

The list is learned by sequential covering. A rule is a conjunction of thresholds. It is grown on two thirds of the
labelled rows by adding the condition of highest information gain, pruned on the other third by dropping its last
conditions while that does not lower its precision there, and kept while its precision is high; the rows that it
covers are set aside and the next rule is grown. The result is an ordered Spark conditional expression.

Fitting uses at most SAMPLE labelled rows, chosen by a hash of their id; every text is judged whole. Null text has
no words. Without labels of both kinds the list is empty and rejects nothing beyond the base rule. Rows are judged
one by one, so repeated rows give repeated results; columns that clash with STATISTICS are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import pieces, text_bytes, tidy

#: Labelled rows that fit the list, at most.
SAMPLE = 20_000
RULES, CONDITIONS, CUTS = 24, 4, 32
#: Share of truly low rows that a rule must reach on the rows it is pruned on, and rows it must cover there.
PRECISION, COVER = 0.97, 5

WINDOW = 5
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
SPACES = [bytes([c]) for c in b"\x20\x09\x0a\x0b\x0c\x0d"]
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper",
              "n_digits", "n_exclaims"]


def repeat_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice; ``ids`` are below ``distinct``."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key, base = ids[:n].copy(), distinct
    for k in range(1, window):
        if base * distinct >= 1 << 62:  # number the beginnings anew before they overflow
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            base = int(key.max()) + 1
        key, base = key * distinct + ids[k:k + n], base * distinct
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + window, dtype=np.int64)
    edges[:n] += twice
    edges[window:] -= twice
    return int((np.cumsum(edges) > 0).sum())


def text_statistics(raw: bytes) -> tuple[int, ...]:
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    chars = len(raw.decode()) if not raw.isascii() else len(raw)
    return (len(words), chars - sum(map(raw.count, SPACES)), sum(map(raw.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeat_words(ids, len(number)), len(lines), len(number), len(raw) - len(raw.translate(None, _UPPER)),
            len(raw) - len(raw.translate(None, _DIGITS)), raw.count(b"!"))


def with_statistics(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with the STATISTICS of their texts, as long columns."""
    docs = docs.drop(*STATISTICS)
    kept = [f for f in docs.schema if keep_text or f.name != "text"]
    schema = T.StructType(kept + [T.StructField(s, T.LongType()) for s in STATISTICS])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                at = part.schema.get_field_index("text")
                rows = np.array([text_statistics(x) for x in text_bytes(part.column(at))], dtype=np.int64)
                columns = [part.column(i) for i in range(part.num_columns) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(rows[:, k]) for k in range(len(STATISTICS))], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


#: What conditions are about; each is a count or a ratio of counts.
FEATURES: dict[str, tuple[str, str | None]] = {
    "words": ("n_words", None), "chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "words_per_line": ("n_words", "n_lines"),
    "distinct_share": ("n_distinct", "n_words"), "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"),
    "exclaims_per_word": ("n_exclaims", "n_words"),
}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        """As Spark sees it; multiplied out, so that nothing is divided. A ratio over 0 counts as 0."""
        top, bottom = FEATURES[self.feature]
        left, right = F.col(top).cast("double"), F.lit(self.cut)
        if bottom:
            left, right = F.when(F.col(bottom) > 0, left).otherwise(F.lit(0.0)), right * F.greatest(F.col(bottom), F.lit(1))
        return left >= right if self.above else left < right

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        top, bottom = FEATURES[self.feature]
        left, right = x[top].astype(float), self.cut
        if bottom:
            left, right = np.where(x[bottom] > 0, left, 0.0), right * np.maximum(x[bottom], 1)
        return left >= right if self.above else left < right


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(x["n_words"]), dtype=bool)
    for condition in rule:
        out &= condition.mask(x)
    return out


def _conditions(x: dict[str, np.ndarray]) -> list[Condition]:
    out = []
    for feature, (top, bottom) in FEATURES.items():
        value = x[top] / np.maximum(x[bottom], 1) if bottom else x[top].astype(float)
        cuts = np.unique(np.quantile(value, np.linspace(0, 1, CUTS + 1)))
        for cut in ((cuts[1:] + cuts[:-1]) / 2).tolist():
            out += [Condition(feature, above, float(f"{cut:.4g}")) for above in (True, False)]
    return out


def grow(x: dict[str, np.ndarray], low: np.ndarray) -> Rule:
    """A conjunction that covers rows of ``low``: FOIL's gain, at most CONDITIONS conditions."""
    rule: Rule = ()
    inside = np.ones(len(low), dtype=bool)
    for _ in range(CONDITIONS):
        p, n = int((inside & low).sum()), int((inside & ~low).sum())
        if not p or not n:
            break
        part = {k: v[inside] for k, v in x.items()}
        now, best, gain = np.log2(p / (p + n)), None, 1e-9
        for condition in _conditions(part):
            mask = condition.mask(part)
            p2, n2 = int((mask & low[inside]).sum()), int((mask & ~low[inside]).sum())
            if p2 and (g := p2 * (np.log2(p2 / (p2 + n2)) - now)) > gain:
                best, gain = condition, g
        if best is None:
            break
        rule += (best,)
        inside &= best.mask(x)
    return rule


def precision(rule: Rule, x: dict[str, np.ndarray], low: np.ndarray) -> tuple[float, int]:
    inside = covers(rule, x)
    return (float(low[inside].mean()) if inside.any() else 0.0), int(inside.sum())


def learn(x: dict[str, np.ndarray], low: np.ndarray) -> list[Rule]:
    """Rules, in order, whose rows are low; every third row prunes, the others grow."""
    rules: list[Rule] = []
    pruning = np.arange(len(low)) % 3 == 2
    open_rows = np.ones(len(low), dtype=bool)
    while len(rules) < RULES:
        growing, held = open_rows & ~pruning, open_rows & pruning
        rule = grow({k: v[growing] for k, v in x.items()}, low[growing])
        xh, lh = {k: v[held] for k, v in x.items()}, low[held]
        while len(rule) > 1 and precision(rule[:-1], xh, lh)[0] >= max(PRECISION, precision(rule, xh, lh)[0]):
            rule = rule[:-1]
        share, covered = precision(rule, xh, lh) if rule else (0.0, 0)
        if share < PRECISION or covered < COVER:
            break
        rules.append(rule)
        open_rows &= ~covers(rule, x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered expression: false where the first rule that fits says low, else true."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for condition in rule:
            test = test & condition.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Decision list from ``labels`` (doc_id, quality 0/1) of ``docs``; rows the base rule rejects teach nothing."""
    chosen = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
              .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # broadcast: at most ``sample`` ids
    rows = (with_statistics(known, keep_text=False).where(~base_failed())
            .orderBy(F.xxhash64("doc_id"), "doc_id", *STATISTICS).limit(sample).toPandas())
    low = (rows["quality"] == 0).to_numpy()
    if not low.any() or low.all():
        return []
    return learn({s: rows[s].to_numpy() for s in STATISTICS}, low)


def judged(docs: DataFrame, rules: list[Rule], keep_text: bool = True) -> DataFrame:
    """``docs`` with their STATISTICS, base_failed and kept."""
    return (with_statistics(docs.drop("base_failed", "kept"), keep_text).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = fit(docs, labels)
    return judged(docs.select("doc_id", "text"), rules, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
