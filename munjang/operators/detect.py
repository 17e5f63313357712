"""Scoring of documents: four layers of evidence, fused into a score of 0 to 100.

Everything here is one chain of projections over (doc_id, text, genre): no
shuffle, whatever the corpus size. Only the tables of hits and of sentences
are longer than the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from munjang.functions import metrics as M
from munjang.functions import registry as R
from munjang.functions.spans import pieces, spans, without_marks
from munjang.functions.text import n_chars, sentences

METRICS = ("comma_inclusion_rate", "comma_usage_rate", "ending_comma_rate", "comma_segment_length")
_FINAL = 0.70


def holds_any(text: Column, literals: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in literals:
        out = out | F.contains(text, F.lit(x))
    return out if literals else F.lit(True)


def _count(text: Column, expression: str, literals: tuple[str, ...], final: bool = False) -> Column:
    """Matches; the expression runs only on texts that hold one of its required strings."""
    if final:
        found = F.size(F.filter(spans(pieces(text, expression)), lambda x: x["start"] / F.greatest(F.length(text), F.lit(1)) >= _FINAL))
    else:
        found = F.regexp_count(text, F.lit(expression))
    return F.when(holds_any(text, literals), found).otherwise(F.lit(0))


def pattern_count(text: Column, p: R.Pattern, apply_min_count: bool = True) -> Column:
    n = _count(text, p.java, p.literals, p.context.endswith("final"))
    return F.when(n >= p.min_count, n).otherwise(F.lit(0)) if apply_min_count and p.min_count > 1 else n


def pattern_counts(text: Column, ids: tuple[str, ...] | None = None, apply_min_count: bool = True) -> Column:
    """array<int> in registry order; unknown ids are passed over, patterns not asked for count 0."""
    return F.array(*[pattern_count(text, p, apply_min_count) if ids is None or p.id in ids else F.lit(0) for p in R.PATTERNS])


def human_counts(text: Column) -> Column:
    return F.array(*[_count(text, h.java, h.literals) for h in R.HUMAN])


def _literal(values: list) -> Column:
    return F.array(*map(F.lit, values))


def density(counts: Column, chars: Column, weights: list[float], caps: list[float]) -> Column:
    """array<struct<count, per_1k, contrib>>: capped weighted density of each pattern."""
    zipped = F.arrays_zip(counts.alias("n"), _literal(weights).alias("w"), _literal(caps).alias("c"))
    size = F.greatest(chars, F.lit(R.LEAST_DENSITY_CHARS))

    def one(x: Column) -> Column:
        per = x["n"] * 1000.0 / size
        return F.struct(x["n"].cast("long").alias("count"), per.alias("per_1k"), (F.least(per, x["c"]) * x["w"]).alias("contrib"))

    return F.transform(zipped, one)


def _total(parts: Column | str) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["contrib"])


def sigmoid(x: Column) -> Column:
    return F.when(x > 60, F.lit(1.0)).when(x < -60, F.lit(0.0)).otherwise(1 / (1 + F.exp(-x)))


def layers(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, genre) with n_chars, sentences, metrics, counts and the four layers. Null texts count as empty, null genres as the default."""
    text = without_marks(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")))
    out = docs.withColumns({"text": text, "genre": F.coalesce("genre", F.lit(R.DEFAULT_GENRE))})
    out = out.withColumns({"n_chars": n_chars("text").cast("long"), "sents": sentences("text"), "pattern_counts": pattern_counts(F.col("text")), "human_counts": human_counts(F.col("text"))})
    out = out.withColumn("metrics", F.struct(*[c.alias(k) for k, c in M.all_metrics("text", F.col("sents")).items()]))
    out = out.withColumn("lengths", M.sentence_lengths("sents"))
    out = out.withColumns(
        {
            "z": F.struct(*[M.metric_z(k, F.col(f"metrics.{k}"), "genre").alias(k) for k in METRICS]),
            "pattern_density": density(F.col("pattern_counts"), F.col("n_chars"), [p.weight for p in R.PATTERNS], [max(p.cap, R.LEAST_CAP) for p in R.PATTERNS]),
            "human_density": density(F.col("human_counts"), F.col("n_chars"), [h.weight for h in R.HUMAN], [6.0] * len(R.HUMAN)),
            "rhythm": F.struct(*[c.alias(k) for k, c in M.rhythm("lengths", F.col("metrics.ending_diversity"), F.col("metrics.declarative_ratio")).items()]),
        }
    )
    ramps = [F.coalesce(F.col(f"rhythm.{k}.strength"), F.lit(0.0)) for k in ("sentence_len_cv", "ending_diversity", "long_sentence_absence", "normalisation_score")]
    return out.withColumns(
        {
            "l1": M.mean_of([F.col(f"z.{k}") for k in METRICS]),
            "l2": F.least(_total("pattern_density") / 20.0, F.lit(6.0)),
            "l3": M.clip(ramps[0] + ramps[1] + ramps[2] + ramps[3], 0.0, 4.0),
            "l4": F.least(_total("human_density") / 12.0, F.lit(3.0)),
        }
    )


def fused(out: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """With logit, score, band and confidence; ``weights`` replace the built-in ones."""
    w = R.FUSION | (weights or {})
    logit = w["l1_calibrated_z"] * F.greatest("l1", F.lit(R.L1_FLOOR)) + w["l2_pattern_density"] * F.col("l2") + w["l3_rhythm"] * F.col("l3") + w["l4_human_evidence"] * F.col("l4") + w["bias"]
    out = out.withColumn("logit", logit).withColumn("score", F.bround(100 * sigmoid(F.col("logit")), 1))
    return out.withColumns({"band": band("score"), "confidence": confidence("n_chars")})


def band(score: Column | str) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c >= R.BANDS[0][0], R.BANDS[0][1]).when(c >= R.BANDS[1][0], R.BANDS[1][1]).otherwise("low")


def confidence(chars: Column | str) -> Column:
    c = F.col(chars) if isinstance(chars, str) else chars
    return F.when(c < R.MIN_CHARS, "insufficient").when(c < R.CONFIDENT_CHARS, "low").otherwise("normal")


def _signal(layer: str, order: Column, key: Column, label: Column, value: Column, detail: Column, strength: Column, calibrated: bool) -> Column:
    return F.struct(F.lit(layer).alias("layer"), order.cast("int").alias("ord"), key.alias("key"), label.alias("label"), value.cast("double").alias("value"), detail.alias("detail"), strength.alias("strength"), F.lit(calibrated).alias("calibrated"))


def signals() -> Column:
    """All evidence of a row of ``layers``, strongest first; equal ones by layer and registry order."""
    first = []
    for i, k in enumerate(METRICS):
        z = F.col(f"z.{k}")
        side = F.when(z > 0, F.lit("AI 쪽")).otherwise(F.lit("사람 쪽"))
        first.append(F.when(F.abs(z) >= 0.8, _signal("L1", F.lit(i), F.lit(k), F.lit(R.METRIC_LABELS[k]), F.round(F.col(f"metrics.{k}"), 4), F.format_string("z=%+.2f (%s)", z, side), M.clip(F.abs(z) / 3, 0.0, 1.0), True)))
    ids = F.array(*[F.struct(F.lit(p.id).alias("id"), F.lit(f"[{p.id}] {p.name}").alias("label"), F.lit(p.category_name).alias("category")) for p in R.PATTERNS])
    second = F.filter(
        F.transform(F.col("pattern_density"), lambda x, i: F.when(x["contrib"] >= 0.5, _signal("L2", 100 + i, ids[i]["id"], ids[i]["label"], x["count"], F.format_string("%d회 · 1,000자당 %.1f회 · %s", x["count"], x["per_1k"], ids[i]["category"]), M.clip(x["contrib"] / 6, 0.0, 1.0), False))),
        lambda x: x.isNotNull(),
    )
    mean = M._share(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x), F.size("lengths"))
    third = []
    texts = {
        "sentence_len_cv": ("문장 길이 변동계수", 3, lambda v: F.format_string("CV=%.2f (사람 통상 0.45~0.75) · 평균 %.0f자", v, mean)),
        "ending_diversity": ("종결어미 다양성", 3, lambda v: F.format_string("%.2f — 같은 어미가 반복됩니다", v)),
        "long_sentence_absence": ("장문(100자+) 부재", 4, lambda v: F.format_string("장문 비율 %.1f%% — 긴 호흡이 없습니다", v * 100)),
        "normalisation_score": ("서술체(-한다/-된다) 집중도", 3, lambda v: F.format_string("%.0f%%의 문장이 동일 서술형으로 끝납니다", v * 100)),
    }
    for i, (k, (label, digits, detail)) in enumerate(texts.items()):
        v, s = F.col(f"rhythm.{k}.value"), F.col(f"rhythm.{k}.strength")
        third.append(F.when(s.isNotNull(), _signal("L3", F.lit(200 + i), F.lit(k), F.lit(label), F.round(v, digits), detail(v), s, False)))
    human = F.array(*[F.struct(F.lit(h.id).alias("id"), F.lit(f"[{h.id}] {h.name}").alias("label")) for h in R.HUMAN])
    fourth = F.filter(
        F.transform(F.col("human_density"), lambda x, i: F.when(x["count"] > 0, _signal("L4", 300 + i, human[i]["id"], human[i]["label"], x["count"], F.format_string("%d회 · 1,000자당 %.1f회 · 사람 글의 증거", x["count"], x["per_1k"]), M.clip(x["contrib"] / 4, 0.0, 1.0), False))),
        lambda x: x.isNotNull(),
    )
    every = F.concat(F.filter(F.array(*first), lambda x: x.isNotNull()), second, F.filter(F.array(*third), lambda x: x.isNotNull()), fourth)
    return F.array_sort(every, lambda a, b: F.when(a["strength"] > b["strength"], -1).when(a["strength"] < b["strength"], 1).otherwise(a["ord"] - b["ord"]))


def notes(fitted: bool = False) -> Column:
    """Remarks on short texts, unfitted weights and metrics left out."""
    skipped = F.size(F.filter(F.array(*[F.col(f"z.{k}") for k in METRICS]), lambda x: x.isNull()))
    each = [
        F.when(F.col("n_chars") < R.MIN_CHARS, F.format_string("%d자로 판정 불가. 최소 150자가 필요합니다 — 짧은 글은 어떤 탐지기도 신뢰할 수 없습니다.", F.col("n_chars"))),
        F.when(F.col("n_chars").between(R.MIN_CHARS, R.CONFIDENT_CHARS - 1), F.format_string("%d자는 신호가 얕습니다. 400자 이상 권장.", F.col("n_chars"))),
        F.lit(None if fitted else "융합 가중치가 아직 실측 피팅되지 않았습니다. 점수를 상대 비교용으로만 쓰세요."),
        F.when(skipped > 0, F.format_string("'%s' 장르에서는 %d개 지표가 판별력이 없거나 방향이 뒤집혀 계산에서 제외했습니다.", F.col("genre"), skipped)),
    ]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def analyze(docs: DataFrame, weights: dict[str, float] | None = None, *more: str) -> DataFrame:
    """One report per row of ``docs``: score, band, confidence, layers, metrics, signals and notes; ``more`` columns of docs as they are, and "sentences" the scored sentences."""
    out = fused(layers(docs), weights)
    out = with_sentence_scores(out) if "sentences" in more else out
    return out.select(
        "doc_id", "genre", "score", "band", "confidence", F.lit(weights is not None).alias("fusion_calibrated"), "n_chars", F.size("sents").cast("long").alias("n_sentences"),
        F.create_map(*[x for k, c in (("l1_calibrated_z", "l1"), ("l2_pattern_density", "l2"), ("l3_rhythm", "l3"), ("l4_human_evidence", "l4"), ("logit", "logit")) for x in (F.lit(k), F.round(c, 3))]).alias("layers"),
        "metrics", signals().alias("signals"), notes(weights is not None).alias("notes"),
        F.map_from_entries(F.filter(F.transform("pattern_counts", lambda n, i: F.struct(_literal([p.id for p in R.PATTERNS])[i].alias("id"), n.alias("n"))), lambda x: x["n"] > 0)).alias("pattern_counts"), *more,
    )


def registry_table(spark: SparkSession) -> DataFrame:
    """The registry as a table; a few dozen rows."""
    rows = [(i, p.id, p.category, p.category_name, p.name, p.severity, p.weight, p.risk, p.min_count, p.cap, p.context, p.java, p.hint) for i, p in enumerate(R.PATTERNS)]
    return spark.createDataFrame(rows, "ord int, pattern_id string, category string, category_name string, name string, severity int, weight double, risk string, min_count int, cap double, context string, expression string, hint string")


def _plain(docs: DataFrame) -> DataFrame:
    """The text that is measured."""
    text = without_marks(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")))
    return docs.select("doc_id", text.alias("text"))


def found_hits(text: Column, ids: tuple[str, ...] | None = None, apply_min_count: bool = True) -> Column:
    """array<struct<start, end, ord, text>> of the matches that count, by place. Each expression is a constant, so it is compiled once, and runs only on texts that hold one of its strings; what follows is one expression for all patterns."""
    asked = [(i, p) for i, p in enumerate(R.PATTERNS) if ids is None or p.id in ids]
    if not asked:
        return F.array().cast("array<struct<start:int,end:int,ord:int,text:string>>")
    cut = F.array(*[F.when(holds_any(text, p.literals), pieces(text, p.java)).otherwise(F.array(F.lit(""))) for _, p in asked])
    known = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p.min_count if apply_min_count else 1).alias("least"), F.lit(p.context.endswith("final")).alias("final")) for i, p in asked])
    size = F.greatest(F.length(text), F.lit(1))

    def one(parts: Column, k: Column) -> Column:
        counted = F.filter(spans(parts), lambda x: ~known[k]["final"] | (x["start"] / size >= _FINAL))
        return F.transform(counted, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), known[k]["ord"].alias("ord"), F.trim(x["text"]).alias("text")))

    return F.array_sort(F.flatten(F.filter(F.transform(cut, one), lambda x, k: F.size(x) >= known[k]["least"])))


def _named(hit: Column) -> Column:
    """A hit with what the registry says of its pattern."""
    known = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in (("pattern_id", p.id), ("category", p.category), ("name", p.name), ("severity", p.severity), ("weight", p.weight), ("hint", p.hint))]) for p in R.PATTERNS])
    own = known[hit["ord"]]
    return F.struct(*[own[k].alias(k) for k in ("pattern_id", "category", "name", "severity", "weight")], hit["start"].alias("start"), hit["end"].alias("end"), hit["text"].alias("text"), own["hint"].alias("hint"), hit["ord"].alias("ord"))


def hits(docs: DataFrame, ids: tuple[str, ...] | None = None, apply_min_count: bool = True) -> DataFrame:
    """doc_id, pattern_id, category, name, severity, weight, start, end, text, hint, ord of every match that counts; those of a row by start and end. One pass over the texts, which do not travel with the hits."""
    found = _plain(docs).select("doc_id", F.explode(found_hits(F.col("text"), ids, apply_min_count)).alias("hit"))
    return found.select("doc_id", _named(F.col("hit")).alias("hit")).select("doc_id", "hit.*")


def sentence_spans(text: Column | str, sents: Column | str) -> Column:
    """array<struct<start, end, text>>: each sentence's place, found from the end of the one before."""
    t = F.col(text) if isinstance(text, str) else text
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("found"))

    def step(acc: Column, s: Column) -> Column:
        at = F.call_function("locate", s, t, acc["at"] + 1)
        start = F.when(at > 0, at - 1).otherwise(acc["at"])
        own = F.struct(start.alias("start"), (start + F.length(s)).alias("end"), s.alias("text"))
        return F.struct((start + F.length(s)).alias("at"), F.array_append(acc["found"], own).alias("found"))

    return F.aggregate(sents, begin, step)["found"]


def once(c: Column) -> Column:
    """``c``, computed once for a row: an expression that counts as nondeterministic is not copied to every place that uses its column."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def _below(starts: Column, x: Column) -> Column:
    """How many of the sorted numbers are less than x: a binary search, as a fold over powers of two."""
    steps = F.array(*[F.lit(1 << k) for k in range(26, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= F.size(starts)) & (F.get(starts, n + step - 1) < x), n + step).otherwise(n))


def _with_sentences(df: DataFrame, ids: tuple[str, ...] | None = None, apply_min_count: bool = True) -> DataFrame:
    """With ``_own``: each sentence of ``text`` and the hits that begin in it. Both are in order of place, so a sentence's hits are one slice, found by search within the row."""
    df = df.withColumns({"_spans": once(sentence_spans("text", sentences("text"))), "_hits": once(found_hits(F.col("text"), ids, apply_min_count))})
    df = df.withColumn("_at", once(F.transform("_hits", lambda h: h["start"])))

    def one(x: Column, i: Column) -> Column:
        first = _below(F.col("_at"), x["start"])
        own = F.slice("_hits", first + 1, F.greatest(_below(F.col("_at"), x["end"]) - first, F.lit(0)))
        return F.struct(i.alias("idx"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.when(F.size("_hits") > 0, own).otherwise(F.slice("_hits", 1, 0)).alias("own"))

    return df.withColumn("_own", once(F.transform("_spans", one))).drop("_spans", "_hits", "_at")


def with_sentence_scores(df: DataFrame) -> DataFrame:
    """With ``sentences``: array<struct<idx, start, end, text, score, hit_ids, hit_names>> of column ``text``. The score is the weight of the hits that begin in a sentence, for its length."""
    known = F.array(*[F.struct(F.lit(p.id).alias("id"), F.lit(p.name).alias("name"), F.lit(p.weight * (0.6 + 0.2 * p.severity)).alias("w")) for p in R.PATTERNS])

    def one(x: Column) -> Column:
        load = F.aggregate(x["own"], F.lit(0.0), lambda a, h: a + known[h["ord"]]["w"]) / F.greatest(F.length(x["text"]), F.lit(1)) * 100
        return F.struct(*[x[k].alias(k) for k in ("idx", "start", "end", "text")], F.bround(M.clip(100 * (1 - F.exp(-load / 5)), 0.0, 100.0), 1).alias("score"), F.transform(x["own"], lambda h: known[h["ord"]]["id"]).alias("hit_ids"), F.transform(x["own"], lambda h: known[h["ord"]]["name"]).alias("hit_names"))

    return _with_sentences(df).withColumn("sentences", once(F.transform("_own", one))).drop("_own")


def sentence_hits(docs: DataFrame, ids: tuple[str, ...] | None = None, apply_min_count: bool = True) -> DataFrame:
    """doc_id, idx, ord, start, end: each hit with the sentence that it begins in."""
    rows = _with_sentences(_plain(docs), ids, apply_min_count).select("doc_id", F.explode("_own").alias("s")).select("doc_id", "s.idx", F.explode("s.own").alias("h"))
    return rows.select("doc_id", "idx", "h.ord", "h.start", "h.end")


def sentence_scores(docs: DataFrame) -> DataFrame:
    """doc_id, idx, start, end, text, score, hit_ids, hit_names of every sentence. No shuffle, no pairs of sentences and hits; null and repeated ids are rows like others."""
    return with_sentence_scores(_plain(docs)).select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.*")
