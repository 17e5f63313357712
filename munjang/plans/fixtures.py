"""Short inline inputs with known answers, as tables for Spark and as VALUES for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from munjang.plans.cases import ROWS

WORDS = ["사람", "요소", "학생", "의자", "서울", "물", "책", "나라", "A", "x1", "제3", "42", "10", "", "가격", "길"]

#: (case, level, input, expected)
REWRITES = [
    ("a8-1", "safe", "고려되어져야 한다", "고려되어야 한다"),
    ("a8-2", "safe", "그렇게 보여진다", "그렇게 보인다"),
    ("a8-3", "safe", "잊혀진 이름", "잊힌 이름"),
    ("d1b-1", "moderate", "이는 중요한 문제라고 할 수 있습니다.", "이는 중요한 문제입니다."),
    ("d1b-2", "moderate", "이것은 혁신이라고 할 수 있습니다.", "이것은 혁신입니다."),
    ("a51-1", "moderate", "조사를 진행했다", "조사했다"),
    ("a51-2", "moderate", "업무를 진행했다", "업무를 진행했다"),
    ("f1-1", "aggressive", "매우 중요한 문제다.", "매우 중요한 문제다."),
    ("a50-1", "moderate", "전쟁으로 인해 문제가 생겼다.", "전쟁 때문에 문제가 생겼다."),
    ("a50-2", "moderate", "폭염으로 인해 문제가 생겼다.", "폭염 때문에 문제가 생겼다."),
    ("a50-3", "moderate", "사건으로 인해 문제가 생겼다.", "사건 때문에 문제가 생겼다."),
    ("c11a-1", "safe", "재난 항목은 사고, 화재, 침수, 정전이다.", "재난 항목은 사고, 화재, 침수, 정전이다."),
    ("c11a-2", "safe", "냉장고, 세탁기, 에어컨을 샀다.", "냉장고, 세탁기, 에어컨을 샀다."),
    ("g2b-1", "moderate", "그렇게 여겨집니다.", "그렇게 보입니다."),
    ("g2b-2", "moderate", "그렇게 여겨진다.", "그렇게 보인다."),
    ("a20-1", "moderate", "경쟁이 심화되고 있다.", "경쟁이 심화된다."),
    ("a20-2", "moderate", "매출이 증가하고 있다.", "매출이 증가하고 있다."),
    ("d1a-1", "moderate", "결론적으로, 세 가지다.", "세 가지다."),
    ("d1a-2", "moderate", "이를 요약하면, 세 가지다.", "이를 요약하면, 세 가지다."),
    ("a3-1", "aggressive", "나는 도서관에 있어서 전화를 못 받았다.", "나는 도서관에 있어서 전화를 못 받았다."),
    ("a17-1", "safe", "다양한 요소들이 있고 많은 사람들이 모였다.", "다양한 요소들이 있고 많은 사람들이 모였다."),
    ("a17-2", "aggressive", "다양한 요소들이 있고 많은 사람들이 모였다.", "다양한 요소가 있고 많은 사람이 모였다."),
    ("d1c-1", "moderate", "그렇다고 볼 수 있습니다.", "그렇다고 볼 수 있습니다."),
    ("nl-1", "safe", "밥을 먹으며,\n둘째 줄이다.", "밥을 먹으며,\n둘째 줄이다."),
    ("a2-1", "aggressive", "교육을 통해 배우고 경험을 통해서 자라며 대화를 통해 가까워진다.", "교육으로 배우고 경험으로 자라며 대화로 가까워진다."),
    ("a2-2", "aggressive", "친구를 통해 알고 교육을 통해 배우고 독서를 통해 깊어진다.", "친구를 통해 알고 교육으로 배우고 독서로 깊어진다."),
    ("a2-3", "aggressive", "교육을 통해 배우고 경험을 통해 자란다.", "교육을 통해 배우고 경험을 통해 자란다."),
    ("a7-1", "moderate", "그는 뛰어난 능력을 가지고 있다.", "그는 뛰어난 능력이 있다."),
    ("a7-2", "moderate", "그는 남다른 재주를 가지고 있습니다.", "그는 남다른 재주가 있습니다."),
    ("d1b-3", "moderate", "이 일은 커다란 혁신이라고 할 수 있다.", "이 일은 커다란 혁신이다."),
    ("d1b-4", "moderate", "이 일은 커다란 기회라고 할 수 있다.", "이 일은 커다란 기회다."),
    ("d1c-2", "moderate", "이 산이 저 산보다 훨씬 크다고 볼 수 있다.", "이 산이 저 산보다 훨씬 크다."),
    ("g2-1", "moderate", "성능이 크게 향상될 수 있을 것으로 보인다.", "성능이 크게 향상될 수 있다."),
    ("c11a-3", "safe", "밥을 먹으며, 책을 읽지만, 잔다.", "밥을 먹으며 책을 읽지만 잔다."),
    ("c50-1", "aggressive", "**가** 그리고 **나** 그리고 **다**", "가 그리고 나 그리고 다"),
    ("c5-2", "safe", "오늘은 좋은 소식 👍 입니다", "오늘은 좋은 소식 입니다"),
    ("d50-1", "aggressive", "급변하는 현대 사회에서, 우리는 무엇을 해야 하는지 늘 고민하며 살아간다.", "우리는 무엇을 해야 하는지 늘 고민하며 살아간다."),
    ("f1-2", "aggressive", "이 산은 매우 높고 저 강은 정말 길다.", "이 산은 높고 저 강은 길다."),
    ("keep-1", "aggressive", '그는 "결론적으로, 매우 중요하고 정말 크다"고 말했다.', '그는 "결론적으로, 매우 중요하고 정말 크다"고 말했다.'),
    ("keep-2", "aggressive", "코드는 `매우 정말 아주` 이고 주소는 https://a.b/매우 이다.", "코드는 `매우 정말 아주` 이고 주소는 https://a.b/매우 이다."),
    ("keep-3", "aggressive", "> 매우 크고 정말 길다.\n본문은 무척 짧고 아주 쉽다.", "> 매우 크고 정말 길다.\n본문은 짧고 쉽다."),
    ("gate-1", "aggressive", "결론적으로, 가", "결론적으로, 가"),
    ("c5-1", "safe", "평점은 ★★★☆☆ 이고 체크는 ✓ 다.", "평점은 ★★★☆☆ 이고 체크는 ✓ 다."),
]

#: Texts for counts and scores. No two matches of one pattern touch, so expressions without lookaround count alike.
TEXTS = [
    (1, "급변하는 현대 사회에서, 기술은 중요하다. 이 연구는 변화를 보여준다. 많은 전문가들이 말한다. 크게 향상될 수 있을 것으로 보인다.", "essay"),
    (2, "하지만, 문제가 있다. 따라서, 대응이 필요하다.\n또한 정책이 중요한 역할을 한다. 첫째, 교육이다. 둘째, 안전망이다. 결론적으로, 협력해야 한다.", "column"),
    (3, "솔직히 나는 잘 모르겠다. 그때 이미 어제 일이 힘들었다. 근데 나중에 그냥 막막했다. 내가 도와주면 좋겠다.", "blog"),
    (4, "- 첫 항목\n- 둘째 항목\n• 셋째 항목\n* 넷째 항목\n- 다섯째 항목\n**굵게** 그리고 **또 굵게** 그리고 **한 번 더** (여섯 글자 넘게)", "report"),
    (5, "회의를 하고, 자료를 만들고, 정리를 하며, 발표를 하면서, 마쳤다. 비가 오지만, 갔다.", "abstract"),
    (6, "", "essay"),
    (7, "A가 좋다. 그는 갔다. 그녀는 왔다. 그것은 책이다. 이것은 펜이다. 그의 집이다. 매우 좋다. 정말 크다. 아주 멀다.", "poetry"),
    (8, "고려되어져야 한다. 잊혀진 이름이다. 보여지는 것이다. 조사를 진행했다. 경쟁이 심화되고 있다. 노력이 필요할 것으로 보인다.", "unknown"),
]

WIKI = [
    ("markup", "{{정보상자|이름=한국어}}\n'''한국어'''는 [[대한민국|한국]]에서 쓰이는 [[언어]]이다.<ref>출처</ref> 세종대왕이 [[훈민정음]]을 창제하면서 표기 체계가 갖추어졌다고 널리 알려져 있다.\n== 역사 ==\n* 목록 항목\n[[분류:언어]]\n{| 표 |}", "한국어는 한국에서 쓰이는 언어이다. 세종대왕이 훈민정음을 창제하면서 표기 체계가 갖추어졌다고 널리 알려져 있다."),
    ("latin", "This line has only Latin letters and is longer than forty characters in all.", ""),
    ("short", "짧은 줄이다.", ""),
    ("empty", "", ""),
]


def quoted(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        parts = value.replace("'", "''").split("\n")
        return "'" + "' || chr(10) || '".join(parts) + "'" if len(parts) > 1 else f"'{parts[0]}'"
    return str(value).upper() if isinstance(value, bool) else str(value)


def values(rows: list[tuple], name: str, columns: str) -> str:
    """A VALUES table for SQL."""
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS {name}({columns})"


def words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in WORDS], "word string")


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "doc_id long, text string, genre string")


def cases(spark: SparkSession) -> DataFrame:
    """The texts of ``cases`` with ids below those of documents and of the inline texts."""
    return spark.createDataFrame([(k - 1000, t, "essay") for k, _, t, _ in ROWS], "doc_id long, text string, genre string")


def rewrites(spark: SparkSession, level: str) -> DataFrame:
    return spark.createDataFrame([(c, t, "essay") for c, lv, t, _ in REWRITES if lv == level], "doc_id string, text string, genre string")


def wiki(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, t) for c, t, _ in WIKI], "case_id string, raw string")
