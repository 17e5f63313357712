"""Scores, hits and rewrites: known answers, bounds and invariants."""

import difflib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from munjang.functions import registry as R
from munjang.functions.dialect import java, required_literals
from munjang.operators import calibrate, corpus, detect, evaluate, history, prompt, report, rewrite
from munjang.plans import fixtures as X
from munjang.sources import documents as S

MACHINE = (
    "급변하는 현대 사회에서, 기술은 우리의 삶에 매우 중요한 영향을 미치고 있다. 이 연구는 그 변화를 보여준다. 많은 전문가들이 지적하듯이, 자동화를 통해 생산성이 크게 향상될 수 있을 것으로 보인다.\n\n"
    "하지만, 동시에 일자리가 줄어드는 측면도 간과할 수 없다. 특히, 반복적인 업무가 그렇다. 이러한 변화는 논의를 필요로 한다고 볼 수 있다.\n\n"
    "따라서, 정책이 중요한 역할을 한다. 첫째, 교육이 확대되어져야 한다. 둘째, 안전망이 강화될 필요가 있다. 결론적으로, 다양한 주체들이 협력해야 하며, 균형 잡힌 접근이 필요하다."
)
PERSON = (
    "어제는 하루 종일 비가 왔다. 그냥 집에 있으려다가 막상 나가 보니 걷기 좋았다. 근데 신발이 젖어서 좀 짜증이 났고 버스를 놓치는 바람에 한참을 정류장에서 떨며 기다려야 했던 걸 생각하면 아직도 헛웃음이 난다.\n"
    "솔직히 나는 이런 날이 싫지 않다. 당시 살던 동네도 꼭 이랬다. 내가 보기엔 사람마다 다르겠지만. 힘들었어도 지나고 나면 다 그립다. 우리 집 앞 빵집 아저씨가 갓 구운 빵을 하나 더 줬던 것도 그해 가을이었다."
)


def table(spark, *texts, genre="essay"):
    return spark.createDataFrame([(i, t, genre) for i, t in enumerate(texts)], "doc_id long, text string, genre string")


def test_registry():
    assert len(R.PATTERNS) == 74 and len(R.HUMAN) == 7 and len(R.BY_ID) == 74
    assert all(p.severity in (1, 2, 3) and p.weight > 0 and p.risk in R.RISKS and p.category in R.CATEGORIES for p in R.PATTERNS)
    assert set(rewrite.REWRITES) <= set(R.BY_ID)
    assert R.BY_ID["D-8a"].weight > 2 * R.BY_ID["D-4"].weight
    assert all(R.BY_ID[k].weight <= 0.4 for k in ("A-1", "A-2", "A-11", "A-16", "I-1"))


def test_required_literals():
    assert required_literals("(?:ab|cde)x?") == ("ab", "cde")
    assert required_literals("a*b?") == ()
    assert required_literals("[xy]z") in (("z",), ("x", "y"))
    assert java("\\U0001F300") == "(?U)\\x{1F300}"


def test_scores(spark):
    rows = {r.doc_id: r for r in detect.analyze(table(spark, MACHINE, PERSON, "결론적으로, 이는 매우 중요하다.", "", None)).collect()}
    assert rows[0].score - rows[1].score > 30
    assert rows[2].confidence == "insufficient"
    assert rows[3].score == rows[4].score == 8.5
    assert rows[0].layers["l4_human_evidence"] < rows[1].layers["l4_human_evidence"]
    assert not rows[0].fusion_calibrated and rows[0].notes
    strengths = [s.strength for s in rows[0].signals]
    assert strengths == sorted(strengths, reverse=True)


def test_density_steps(spark):
    filler = "오늘은 그저 평범한 하루였다고 적어 둔다. " * 53
    l2 = [r.l2 for r in detect.layers(table(spark, *[filler + "결론적으로 그렇다. " * n for n in (1, 2, 4)])).orderBy("doc_id").collect()]
    assert l2[1] - l2[0] > 0.05 and l2[2] - l2[1] > 0.05


def test_context(spark):
    body = "본문 문장이다. " * 20
    found = {(r.doc_id, r.pattern_id) for r in detect.hits(table(spark, "향후 계획을 세운다. " + body, body + "향후 계획을 세운다.", "경로의 우선순위를 정한다.")).collect()}
    assert (0, "D-11") not in found and (1, "D-11") in found and (2, "A-19") not in found
    three = "이것이 아니라 저것이다. 사람이 아니라 기계다. 물이 아니라 불이다."
    assert "C-8b" in {r.pattern_id for r in detect.hits(table(spark, three)).collect()}


def test_spans_are_code_points(spark):
    text = "😀😀 결론적으로, 그렇다."
    row = detect.hits(table(spark, "😀. " + text), ("D-1b", "C-5")).collect()
    assert all(("😀. " + text)[r.start : r.end].strip() == r.text for r in row) and row


def test_sentence_scores(spark):
    rows = detect.sentence_scores(table(spark, MACHINE)).collect()
    assert max(r.score for r in rows) - min(r.score for r in rows) > 20
    assert all(MACHINE[r.start : r.end] == r.text for r in rows)


@pytest.mark.parametrize("level", R.RISKS)
def test_golden_rewrites(spark, level):
    got = {r.doc_id: r.text for r in rewrite.polish(X.rewrites(spark, level), level, scores=False).collect()}
    assert got == {c: e for c, lv, _, e in X.REWRITES if lv == level}


def test_protected_and_gate(spark):
    code = "```\n많은 사람들이 매우 중요한 매우 큰\n```"
    quote = '그는 "결론적으로, 매우 중요하다, 정말 그렇다"고 말했다.'
    nested = '그는 "여기 `코드 매우` 그리고 https://a.b/매우 를 보라"고 했다.'
    rows = {r.doc_id: r for r in rewrite.polish(table(spark, code, quote, nested, MACHINE, "결론적으로, 가"), "aggressive").collect()}
    assert "많은 사람들이 매우 중요한 매우 큰" in rows[0].text
    assert rows[1].text == quote and rows[2].text == nested
    assert rows[3].after_score < rows[3].before_score and rows[3].change_rate < 0.30 and not rows[3].aborted
    assert rows[4].aborted and rows[4].text == rows[4].original and rows[4].change_rate == 0 and not rows[4].changes
    safe = rewrite.polish(table(spark, MACHINE), "safe", scores=False).first()
    assert safe.change_rate < 0.06


def test_particles_follow(spark):
    out = rewrite.polish(table(spark, "여러 문제들이었다. 다양한 요소들이지만 하나다."), "aggressive", scores=False).first().text
    assert not any(x in out for x in ("가었", "가지만", "가라면", "가며"))


def test_evaluation_edges(spark):
    none = spark.createDataFrame([("a", 0, 10.0), ("b", 1, 5.0)], "slice string, positive int, score double")
    assert {r.slice: r.auroc for r in evaluate.auroc(none).collect()} == {"a": 0.5, "b": 0.5}
    points = {(r.slice, r.target_fpr): r for r in evaluate.operating_points(none, (0.1, 1.0)).collect()}
    assert points["b", 0.1].threshold == 50.0 and points["a", 1.0].threshold == 0.0 and points["b", 0.1].tpr == 0.0


def test_parsers(tmp_path):
    record = lambda tag, p: ((tag | len(p) << 20).to_bytes(4, "little") + p) if len(p) < 4095 else (tag | 4095 << 20).to_bytes(4, "little") + len(p).to_bytes(4, "little") + p
    control = (11).to_bytes(2, "little") * 8
    body = record(66, b"xx") + record(67, "가나".encode("utf-16-le") + control + "\r".encode("utf-16-le") + "다".encode("utf-16-le")) + record(67, ("라" * 3000).encode("utf-16-le"))
    packer = zlib.compressobj(wbits=-15)
    packed = packer.compress(body) + packer.flush()
    want = "가나\n다\n\n" + "라" * 3000
    assert S.hwp_sections([body], False) == S.hwp_sections([packed], True) == want
    bomb = zlib.compressobj(wbits=-15)
    with pytest.raises(S.ParseError):
        S.Budget(1000).inflate(bomb.compress(bytes(100_000)) + bomb.flush())
    assert S.parse(b"x", ".xyz")[1] and S.parse(None, None)[1]


def test_sources(spark, tmp_path):
    for name, data in __import__("munjang.plans.queries", fromlist=["x"])._sample_files():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in S.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.docx"].text == "첫 문단\n\n둘째\t문단" and rows["f.docx"].error and "e.xyz" not in rows
    dump = tmp_path / "dump.xml"
    dump.write_text("<mediawiki><page><title>A</title><ns>0</ns><revision><text>가</text></revision></page><page><title>B</title><ns>1</ns><revision><text>나</text></revision></page></mediawiki>")
    assert [(r.title, r.ns) for r in S.read_wiki_dump(spark, str(dump)).orderBy("title").collect()] == [("A", 0), ("B", 1)]


def test_wiki_and_admission(spark):
    pages = spark.createDataFrame([("a", 0, "가나다라 " * 120), ("b", 1, "가나다라 " * 120), ("c", 0, "#REDIRECT [[a]]")], "title string, ns long, text string")
    assert [r.title for r in corpus.wiki_pages(pages).collect()] == ["a"]
    docs = spark.createDataFrame([("human", "essay", "가" * 500), ("human", "blog", "가" * 500), ("ai", "essay", "가" * 500), ("human", "essay", "짧다")], "label string, genre string, text string")
    assert sorted((r.label, r.genre) for r in corpus.admit(docs).collect()) == [("ai", "essay"), ("human", "blog")]
    assert corpus.admit(docs, corpus.admit(docs)).count() == 0


def test_history(spark):
    kinds = "id long, kind string, text string, score double"
    log = spark.createDataFrame([(1, "detect", "a", 1.0), (2, "detect", "a", 2.0), (3, "humanize", "a", None), (4, "detect", " ", 1.0)], kinds)
    assert sorted(r.id for r in history.without_repeats(log).collect()) == [1, 3]
    out = history.append(log.where("id <= 1").withColumn("preview", F.lit("p")), log.where("id > 1"), kept=1)
    assert [r.id for r in out.collect()] == [3]


def test_append_past_repeats_and_blanks(spark):
    kinds = "id long, kind string, text string, score double"
    log = spark.createDataFrame([(i, "detect", t, 1.0) for i, t in enumerate("xyz", 1)], kinds).withColumn("preview", F.lit("p"))
    new = [(10, "detect", "m", 1.0), *[(i, "detect", "hot", 1.0) for i in range(11, 41)], *[(i, "detect", " ", 1.0) for i in range(41, 71)]]
    assert [r.id for r in history.append(log, spark.createDataFrame(new, kinds), kept=3).collect()] == [11, 10, 3]
    rows = [(i, "detect", "ab "[(i * i // 7) % 3], 1.0) for i in range(300)]
    want = {r.id for r in history.without_repeats(spark.createDataFrame(rows, kinds)).collect()}
    assert {r.id for r in history.append(log.limit(0), spark.createDataFrame(rows, kinds)).collect()} == want


def test_calibration(spark):
    rows = [(i, i % 2, float(i % 2) + (i % 7) * 0.3, 0.5 * (i % 3), 0.1 * (i % 5), 0.2 * (i % 4)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, label int, l1 double, l2 double, l3 double, l4 double")
    weights = calibrate.fit(df)
    assert weights["l1_calibrated_z"] > 0 and set(weights) == set(R.FUSION)
    assert calibrate.read_weights(calibrate.weights_json(weights)) == weights and calibrate.read_weights("{") is None
    with pytest.raises(ValueError):
        calibrate.fit(df.limit(10))


def test_fit_agrees_with_plain_descent(spark):
    r = np.random.default_rng(2)
    x = np.column_stack([r.normal(0, 1, 300), r.gamma(2, 0.5, 300), r.uniform(0, 2, 300), r.uniform(0, 1, 300)])
    y = (r.random(300) < 1 / (1 + np.exp(-(x @ [1.0, 1.2, 0.5, -1.0] - 1.5)))).astype(int)
    w, b = np.zeros(4), 0.0
    for _ in range(3000):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.3 * (x.T @ error / len(y) + calibrate.RIDGE * w), b - 0.3 * error.mean()
    rows = [(i, int(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    got = calibrate.fit(spark.createDataFrame(rows, "doc_id long, label int, l1 double, l2 double, l3 double, l4 double"))
    assert np.abs(np.array(list(got.values())) - [*w, b]).max() < 2e-2


def test_calibration_from_end_to_end(spark, tmp_path):
    rows = [(i, (PERSON, MACHINE)[i % 2][i % 5 * 10 :] + f" {i}", "essay", i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, genre string, label int")
    weights, baseline = calibrate.run(docs)
    assert not list(tmp_path.iterdir()) and set(weights) == set(R.FUSION)
    assert baseline["genres"]["essay"]["comma_inclusion_rate"]["n"] == 30
    calibrate.run(docs, f"file://{tmp_path}/w", f"file://{tmp_path}/b")
    text = "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/w", wholetext=True).collect())
    assert calibrate.read_weights(text) == weights and '"_n_human": 30' in text


def test_evaluation_of_a_labelled_corpus(spark):
    rows = [(i, (PERSON, MACHINE)[i % 2] if i < 8 else (PERSON[:120] if i == 8 else MACHINE), "essay" if i < 8 else "blog", i % 2) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, genre string, label int")
    scored = evaluate.score_rows(docs)
    again = evaluate.score_rows(corpus.adversarial(docs.where("label = 1").drop("label"), "aggressive").withColumn("label", F.lit(1)))
    got = {r.slice: r for r in evaluate.evaluation(scored, again).collect()}
    assert got["overall"].auroc == 1.0 and got["overall"].operating_points[0].tpr == 1.0 and (got["overall"].n_human, got["overall"].n_ai) == (5, 5)
    assert got["length 0-150"].n_ai == 0 and got["adversarial"].n_human == 5 and got["adversarial"].mean_ai < got["overall"].mean_ai
    said = {r.slice: r.block for r in evaluate.blocks(evaluate.evaluation(scored)).collect()}
    assert said["length 0-150"].endswith("too few texts") and "AUROC 1.0000" in said["overall"] and len(said["overall"].split("\n")) == 5
    assert '"auroc":1.0' in {r.slice: r.result for r in evaluate.as_json(evaluate.evaluation(scored)).collect()}["overall"]
    points = {r.slice: r for r in evaluate.operating_points(evaluate.slices(scored), (0.01,)).collect()}
    assert abs(points["overall"].threshold - got["overall"].operating_points[0].threshold) < 0.01


def test_rows_with_null_and_repeated_ids(spark):
    rows = [(None, MACHINE, "essay"), (5, MACHINE, "essay"), (5, "결론적으로, 매우 정말 짧다.", "essay"), (5, MACHINE, "essay")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, genre string")
    alone = {t: r for _, t, _ in rows for r in rewrite.polish(table(spark, t)).collect()}
    got = rewrite.polish(docs).collect()
    assert sorted((str(r.doc_id), r.before_score, r.after_score, r.text) for r in got) == sorted((str(d), alone[t].before_score, alone[t].after_score, alone[t].text) for d, t, _ in rows)
    assert corpus.adversarial(docs, "moderate").count() == 4 - sum(alone[t].aborted for _, t, _ in rows)
    single = detect.sentence_scores(table(spark, MACHINE)).count()
    assert detect.sentence_scores(docs).where("doc_id IS NULL").count() == single
    assert detect.sentence_scores(docs).where("doc_id = 5").count() == 2 * single + 1
    assert len(report.report_json(docs).collect()) == 4 and len(prompt.prompts(docs).collect()) == 4


def test_hits_come_in_order(spark):
    found = detect.hits(table(spark, MACHINE + PERSON)).collect()
    assert len(found) > 10 and [(r.start, r.end) for r in found] == sorted((r.start, r.end) for r in found)
    inside = detect.sentence_hits(table(spark, MACHINE + PERSON)).collect()
    spans = {r.idx: r for r in detect.sentence_scores(table(spark, MACHINE + PERSON)).collect()}
    assert inside and all(spans[r.idx].start <= r.start < spans[r.idx].end for r in inside)
    assert sum(len(r.hit_ids) for r in spans.values()) == len(inside)


def test_imports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("사람이 쓴 글이다. " * 60)
    (tmp_path / "in" / "b.md").write_text("짧다.")
    (tmp_path / "in" / "c.docx").write_bytes(b"broken")
    folder = str(tmp_path / "in")
    with pytest.raises(ValueError):
        corpus.import_files(spark, [folder], "human")
    kept, failed = corpus.import_files(spark, [folder, folder], "human", before_models=True)
    assert kept.count() == 1 and failed.count() == 1
    assert corpus.import_files(spark, [folder], "human", before_models=True, existing=kept)[0].count() == 0
    page = lambda title, ns, text: f"<page><title>{title}</title><ns>{ns}</ns><revision><text>{text}</text></revision></page>"
    long = "가나다라마바사 " * 80
    dump = tmp_path / "kowiki-20221001-pages.xml"
    dump.write_text("<mediawiki>" + page("A", 0, long) + page("B", 1, long + "나") + page("C", 0, "  #redirect [[A]] " + long) + page("D", 0, "#넘겨주기 [[A]] " + long) + page("E", 0, long + "마") + page("F", 0, "") + "</mediawiki>")
    assert corpus.import_wiki(spark, str(dump), "human").count() == 2
    assert corpus.import_wiki(spark, str(dump), "human", limit=1).count() == 1
    late = tmp_path / "kowiki-20240101-pages.xml"
    late.write_text(dump.read_text())
    with pytest.raises(ValueError):
        corpus.import_wiki(spark, str(late), "human")
    assert corpus.import_wiki(spark, str(late), "ai", force=True).count() == 2
    (tmp_path / "topics").write_text("첫 주제\n\n  둘째 주제  \n")
    assert sorted(r.topic for r in corpus.topics_of_file(spark, str(tmp_path / "topics")).collect()) == ["둘째 주제", "첫 주제"]


def test_hwp_streams():
    record = lambda text: (67 | 2 * len(text) << 20).to_bytes(4, "little") + text.encode("utf-16-le")
    header = lambda flags: b"HWP Document File".ljust(36, b"\0") + flags.to_bytes(4, "little")
    packer = zlib.compressobj(wbits=-15)
    packed = packer.compress(record("둘")) + packer.flush()
    packer = zlib.compressobj(wbits=-15)
    streams = {"FileHeader": lambda: header(1), "BodyText/Section10": lambda: packed, "BodyText/Section2": lambda: packer.compress(record("하나")) + packer.flush(), "DocInfo": bytes}
    assert S.hwp_body(streams) == "하나\n\n둘"
    for bad in ({}, {"FileHeader": lambda: b"x"}, {"FileHeader": lambda: header(2), "BodyText/Section0": bytes}, {"FileHeader": lambda: header(0)}):
        with pytest.raises(S.ParseError):
            S.hwp_body(bad)


def test_stream_scores_as_batch(spark, tmp_path):
    from munjang.streaming import scores

    docs = X.texts(spark)
    docs.write.parquet(str(tmp_path / "in"))
    stream = scores.score_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {r.doc_id: r.score for r in spark.table("scored").collect()}
    assert got == {r.doc_id: r.score for r in detect.fused(detect.layers(docs)).collect()}


def test_log_stream(spark, tmp_path):
    from munjang.streaming import scores

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, 'detect' AS kind, 'a' AS text UNION ALL SELECT timestamp'2024-01-01 00:01:00', 'detect', 'a' UNION ALL SELECT timestamp'2024-01-01 00:02:00', 'detect', 'b'")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = scores.log_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("logged").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r.text for r in spark.table("logged").collect()) == ["a", "b"]


def _difflib_matched(a, b):
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_matched_as_difflib():
    r = random.Random(5)
    for n in range(600):
        letters = "ab" if n % 2 else "abcdef 가나😀"
        a = "".join(r.choices(letters, k=r.randint(0, 120)))
        b = list(a) if n % 3 else r.choices(letters, k=r.randint(0, 120))
        for _ in range(r.randint(0, 6)):
            b.insert(r.randint(0, len(b)), r.choice(letters))
            del b[r.randrange(len(b))]
        assert rewrite.matched(a, "".join(b)) == _difflib_matched(a, "".join(b)), (a, b)
    a = PERSON * 3
    assert rewrite.matched(a, a[40:300] + "x" + a[200:]) == _difflib_matched(a, a[40:300] + "x" + a[200:])


def test_change_rate_of_whole_texts(spark, tmp_path):
    from munjang.plans.queries import QUERIES

    texts = ["ABC 123, " * 60 + "all of it differs here " * 20, "same in front. " * 30 + "Then CAPITALS. " * 30, "", "1" * 500]
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.rate for r in QUERIES["str_14_change_rate"](spark, str(tmp_path)).collect()}
    assert got == {i: 1 - difflib.SequenceMatcher(None, t, t.upper(), autojunk=False).ratio() if t else 0.0 for i, t in enumerate(texts)}


def test_queries_over_documents_and_inline_texts(spark, tmp_path):
    from munjang.plans.queries import QUERIES

    late = "본문 문장이다. " * 20 + "향후 계획을 세운다."
    docs = [(1, MACHINE, "en", "web"), (2, PERSON, "fr", "web"), (3, late, "de", "web"), (4, "The cat  sat , there.", "es", "web")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    ids = sorted([1, 2, 3, 4, *[i - 100 for i, _, _ in X.TEXTS]])
    for name in ("rw_2_polish", "str_16_prompts", "snk_5_report_text", "snk_6_report_json", "agg_4_human_counts_on_documents", "flt_1_pattern_subset_on_documents"):
        rows = run(name)
        assert sorted(r.doc_id for r in rows) == ids, name
        if name == "rw_2_polish":
            alone = {r.doc_id - 100: r.text for r in rewrite.polish(X.texts(spark), "aggressive").collect()}
            polished = {r.doc_id: r.text for r in rows}
            assert polished[4] == "The cat sat, there." and polished[1] != MACHINE and {k: polished[k] for k in alone} == alone
    found = {(r.doc_id, r.pattern_id): r.n for r in run("agg_1_pattern_counts_on_documents")}
    assert found[3, "D-11"] == 1 and {k[0] for k in found} >= {1, 3, -99}
    assert {r.doc_id for r in run("evl_5_adversarial_on_documents")} & {1, 2, 3, 4}
