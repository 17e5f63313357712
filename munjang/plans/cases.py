"""Texts with known answers for every pattern and human signal.

For each id: two texts that reach its least count, with the count, and one
text that comes close but counts nothing. Matches of one pattern do not touch,
so that expressions whose lookaround consumes a letter count alike.
"""

from __future__ import annotations

#: id: (text, count, text, count, text that counts 0)
CASES: dict[str, tuple[str, int, str, int, str]] = {
    "A-1": ("경제에 대해 말하고, 정치에 대하여 쓰고, 사회에 대해서 묻고, 문화에 대해 듣는다.", 4, "삶에 대해, 죽음에대해, 사랑에 대하여, 전쟁에 대해서, 평화에 대해.", 5, "경제에 대해 말하고 정치에 대한 글과 사회에 대해서는 쓴다."),
    "A-2": ("교육을 통해 배우고 경험을 통해서 자라며 대화를 통해 가까워진다.", 3, "실험을통해 알고 관찰을 통해 보고 독서를 통해서 깊어지고 여행을 통해 넓어진다.", 4, "교육을 통해 배우고 길을 통해 간다."),
    "A-3": ("이 문제에 있어 중요하다.", 1, "교육에 있어서, 그리고 삶에 있어 그렇다.", 2, "집에 있어요. 방에 있어서는 안 된다."),
    "A-4": ("새롭다는 점에서 좋고 쉽다는 점에서 낫다.", 2, "최초라는 점에서, 유일하다는점에서 그렇다.", 2, "새롭다는 점에서 좋다."),
    "A-5": ("정책과 관련하여 묻고 예산과 관련된 답을 듣는다.", 2, "문화와 관련한 행사와 관련해서 그 제도와 관련되어 있다.", 3, "정책과 관련 있는 일과 관련하여 묻는다."),
    "A-6": ("자료에 기반하여 쓰고 경험을 바탕으로 고친다.", 2, "법에 근거하여 정하고 사실에 기반한 글과 통계에 기반해 본다.", 3, "자료에 기반하여 쓴다. 경험이 바탕이다."),
    "A-7": ("그는 능력을 가지고 있다.", 1, "의미를 가지고 있으며 가치를 가지고있는 책이다.", 2, "공을 가지고 있다. 가방을 가지고 갔다."),
    "A-8": ("그렇게 보여진다.", 1, "잊혀진 이름이 불려졌다.", 2, "그렇게 보인다. 길이 만들어진다."),
    "A-9": ("정부에 의해 정해졌다.", 1, "법률에 의한 것과 전문가에 의하여 정한 것.", 2, "너에 의해 그렇다."),
    "A-11": ("국민을 위해 일하고 나라를 위해 싸우고 가족을 위하여 벌고 미래를 위한 돈을 모은다.", 4, "성장을 위해 개혁을 위한 변화를 위하여 안정을 위해 모두를 위해.", 5, "국민을 위해 일하고 나라를 위해서 싸운다."),
    "A-12": ("규칙이 만들어지고 합의가 이루어졌다.", 2, "그렇게 이루어진 도시와 만들어진다 하는 말과 이루어져 있다.", 3, "규칙이 만들어지며 합의가 이루어진다."),
    "A-14": ("먹었다. 그리고 잤다. 그리고 일어났다. 그리고 갔다.", 3, "하나, 그리고 둘, 그리고 셋, 그리고 넷, 그리고 다섯.", 4, "먹었다. 그리고 잤다. 쓰리고 아팠다. 그리고, 갔다."),
    "A-15": ("이 연구는 변화를 보여준다.", 1, "조사 결과는 문제가 크다는 점을 시사한다. 해당 보고서가 대안을 제시한다.", 2, "연구자는 변화를 보여준다. 이 연구는 변화를 말했다."),
    "A-16": ("그는 왔다. 그녀는 갔다. 그들은 봤다. 그것은 컸다. 이것은 작다.", 5, "그의 집, 그녀의 방, 그것을 보고 이것을 사고 그들의 말을 듣고 그는 갔다.", 6, "그는 왔다. 그녀는 갔다. 나그네는 봤다. 우리의 것은 컸다."),
    "A-17": ("많은 사람들이 여러 나라들을 봤다.", 2, "다양한 요소들과 모든 문제들은 온갖 일들을 만든다.", 3, "많은 사람들이 왔다. 여러 사람들이다."),
    "A-19": ("한국에서의 변화다.", 1, "학교로부터의 편지와 꿈에의 길이다.", 2, "미래로의 길과 학교의 편지다."),
    "A-20": ("경쟁이 심화되고 있다.", 1, "길이 넓어지고 있으며 값이 인상되고있습니다.", 2, "되고 있다. 먹고 있다. 심화되고 있지 않다."),
    "A-21": ("단순한 도구를 넘어 동반자가 됐다.", 1, "이제 기술은 한계를 넘어 간다. 단순 작업을 넘어 창작으로.", 2, "담장을 넘어 갔다. 단순한 도구다. 벽을 넘어."),
    "A-50": ("전쟁으로 인해 집을 잃었다.", 1, "비로 인해서 젖고 사고로 인해 다쳤다.", 2, "전쟁 때문에 집을 잃었다. 확인해 본다."),
    "A-51": ("조사를 진행했다.", 1, "회의를 진행하고 점검을 실시한 뒤 과제를 수행합니다.", 3, "조사를 진행시켰다. 일을 진행했다."),
    "B-1": ("인공지능(artificial intelligence)과 학습(learning)을 본다.", 2, "모형 (model)과 자료(data)와 망(neural-net)을 쓴다.", 3, "한국(KR)과 일본(JP), 학습(learning)을 본다."),
    "B-4": ("장인이라고 알려진 사람이다.", 1, "천재라 불리는 사람과 거장으로 일컬어지는 사람.", 2, "널리 알려진 사람이라 부른다."),
    "C-1": ("첫째, 길이 멀다. 둘째 돈이 없다.", 2, "첫 번째로 밥을 먹고 세 번째로, 잤다.", 2, "첫째는 크고 맏첫째 아들이다."),
    "C-2": ("- 하나\n- 둘\n* 셋\n• 넷\n· 다섯", 5, "  - 가\n  - 나\n  - 다\n  - 라\n  - 마\n  - 바", 6, "- 하나\n- 둘\n-셋\n• 넷\n다섯 - 여섯"),
    "C-5": ("좋다 👍 정말 ✅✅ 끝", 2, "일정 1️⃣ 그리고 🇰🇷 이다", 2, "평점은 ★★★☆☆ 이고 체크는 ✓ 다."),
    "C-8": ("꿈인가, 현실인가. 빛인가? 어둠인가.", 2, "적인가, 벗인가. 말인가, 뜻인가. 안인가, 밖인가.", 3, "꿈인가, 현실인가. 그런가 보다."),
    "C-8b": ("말이 아니라 뜻이다. 늦은 것은 아니다.", 2, "돈이 아니라 시간이고 힘이 아니라 꾀이며 하는 것이 아니라, 본다.", 3, "말이 아니라 뜻이다. 그렇지 않다."),
    "C-9": ("1) 가고 2) 보고 3) 온다", 3, "가 1) 나 2) 다 3) 라 4) 마", 4, "1) 가고 12) 보고 3)온다"),
    "C-10": ("# 시작하며: 왜 지금인가\n## 본론이다: 무엇을", 2, "### 첫머리: 가\n본문\n#### 끝머리: 나\n# 부록들: 다", 3, "# 시작하며\n## 본론: 무엇을\n##### 너무 깊은: 제목"),
    "C-11a": ("밥을 먹으며, 책을 읽지만, 잔다.", 2, "걸어서, 가면서, 웃으며 , 온다.", 3, "밥을 먹으며, 책을 읽지만 잔다. 하고, 논다."),
    "C-11b": ("마시고, 달리고, 노래하고, 간다.", 3, "보내고, 기다리고, 만나고, 헤어지고, 간다.", 4, "마시고, 달리고,\n노래하고, 3시에 간다."),
    "C-50": ("**가** 그리고 **나** 그리고 **다**", 3, "**하나** **둘** **셋** **넷**", 4, "**가** 그리고 *나* 그리고 **다"),
    "D-1a": ("결론적으로, 우리는 이겼다.", 1, "졌다. 요약하면 길다. 정리하자면, 끝났다.", 2, "우리는 결론적으로 이겼다."),
    "D-1b": ("이것은 혁신이라고 할 수 있다.", 1, "문제라고 볼 수 있습니다. 그것은 기회라고 할수있다.", 2, "혁신이라고 할 수 없다."),
    "D-1c": ("그렇다고 볼 수 있다.", 1, "옳다고 할 수 있습니다. 크다고 볼 수 있다.", 2, "그렇다고 생각할 수 있다."),
    "D-1d": ("큰 일이라 하겠다.", 1, "실패에 다름 아니다. 옳은 일이라 할 것이다.", 2, "일이라 하였다. 다름이 아니다."),
    "D-2": ("시사하는 바가 크다. 주목할 만하다.", 2, "시사점을 준다. 간과할 수 없다. 의미심장하다.", 3, "시사하는 바가 크다. 의미가 적다."),
    "D-3": ("크게 3 가지로 나뉜다.", 1, "이유는 다음과 같다. 결과는 아래와 같습니다.", 2, "크게 여러 가지로 나뉜다. 다음과 다르다."),
    "D-4": ("혁신적인 기술과 획기적인 제품과 파격적인 값이다.", 3, "압도적 힘, 폭발적 성장, 눈부신 발전, 전례 없는 일.", 4, "혁신적인 기술과 비혁신적인 제품과 압도적 힘."),
    "D-5": ("시대가 우리에게 묻는다.", 1, "데이터는 말한다. 시장은 변화를 요구한다.", 2, "신기술이 묻는다. 시대를 말한다."),
    "D-6": ("이제 행동할 때다.", 1, "앞으로 나아갈 때입니다. 지금은 준비할 시점이다.", 2, "갈 때다. 일할 때가 왔다."),
    "D-7": ("'소유하기'에서 '공유하기'로 바뀐다.", 1, '‘빠르기’를 넘어 ‘바르기’로. "경쟁"에서 "협력"로 간다.', 2, "'소유'에서 공유로 바뀐다."),
    "D-8a": ("필요한 것은 방향이다.", 1, "중요한 건 속도다. 시급한 것은 대책입니다.", 2, "불필요한 것은 짐이다. 필요한 책이다."),
    "D-8b": ("문제는 돈이다.", 1, "관건은 시간이다. 더 심각한 것은 무관심입니다.", 2, "큰문제는 돈이다. 문제는, 돈"),
    "D-9a": ("성장으로 이어진다.", 1, "생존에 직결된다. 실패로 귀결된다.", 2, "성장으로 이어졌다. 생존과 직결된다."),
    "D-9b": ("결국 졌다. 결국 갔다.", 2, "결국, 이겼다. 그는 결국 왔다. 결국.", 3, "결국 졌다. 결국은 갔다."),
    "D-10": ("우리가 기억하는 이유다.", 1, "오늘도 달리는 이유다. 그것이 이유다.", 2, "이유다. 그 이유는 많다."),
    "D-11": ("비가 왔다. 길이 젖었다. 사람들이 걸었다. 바람이 불고 눈이 내렸다. 향후 좋아진다.", 1, "비가 왔다. 길이 젖었다. 사람들이 걸었다. 바람이 불고 눈이 내리고 해가 떴다. 앞으로 낫다. 중장기적으로 낫다.", 2, "향후 좋아진다. 비가 왔다. 길이 젖었다. 사람들은 앞으로 걸었다. 바람이 앞으로 불었다."),
    "D-12": ("물론 과제도 남아 있다.", 1, "좋다. 하지만 한계도 분명하다. 그래도 낫다. 아쉬운 점도 있다.", 2, "우리가 그동안 풀지 못한 아주 큰 과제도 남아 있다."),
    "D-13": ("어쩌면 맞다. 비로소 알았다.", 2, "천천히 걷고 어쩌면 뛰고 비로소 쉰다.", 3, "어쩌면 맞다. 천천히도 간다."),
    "D-14a": ("진단은 서늘하다.", 1, "현실이 아프다. 메시지는 묵직하다.", 2, "오진단은 서늘하다. 진단은 옳다."),
    "D-14b": ("시장을 잠식하고 청사진을 그렸다.", 2, "적신호가 켜지고 신호탄이 오르며 뿌리내리는 중이다.", 3, "시장을 잠식했다. 청사과를 샀다."),
    "D-14c": ("청구서가 왔고 씨앗을 심고 문턱을 넘었다.", 3, "주춧돌과 성적표, 양날의 검, 그리고 짊어지는 일.", 4, "청구서와 씨앗이다."),
    "D-50": ("급변하는 현대 사회에서, 산다.", 1, "오늘날 우리는 걷는다. 4차 산업혁명 시대, 뛴다.", 2, "우리는 현대 사회에서 산다. 4차 산업혁명 시대에 산다."),
    "F-1": ("매우 크고 정말 좋다.", 2, "아주 멀고 무척 춥고 대단히 길다.", 3, "매우 크다. 안정말 좋다."),
    "F-3": ("중요한 역할을 한다.", 1, "핵심적인 역할과 중추적 역할, 기능을 수행한다.", 3, "중요한 역할을 했다. 핵심 역할이다."),
    "F-5": ("사회적 구조적 문제다.", 1, "정치적인 경제적 위기와 문화적 역사적인 뜻이다.", 2, "사회적 문제다. 목적 없는 글이다."),
    "F-7": ("확대해야 하고, 강화하고, 개선하며 간다.", 3, "확보가 필요하고 마련이 아니라 유지하며 구축하고 지원해야 한다.", 4, "확대해야 한다. 재강화하고 간다. 집중하며 본다."),
    "G-1": ("갈 것으로 보인다. 올 것으로 나타났다.", 2, "것으로 판단된다. 것으로 예상된다. 것으로확인되었다.", 3, "갈 것으로 보인다. 것으로 본다."),
    "G-2": ("향상될 수 있을 것으로 보인다.", 1, "성공할 수 있을 것으로 전망된다. 나아갈 수 있을 것으로 판단된다.", 2, "볼 수 있을 것으로 보인다. 성공할 수 있다."),
    "G-2b": ("옳다고 여겨진다.", 1, "그렇게 사료됩니다. 크다고 여겨집니다.", 2, "그렇게 여겨졌다. 생각된다."),
    "G-3": ("양쪽 모두 옳다. 두 가지 모두 좋다. 장점도 있지만 신중한 접근이다.", 4, "균형 잡힌 글, 균형 있는 말, 단점도 있지만, 신중한 접근, 양쪽 모두.", 5, "양쪽 모두 옳다. 균형 잡힌 글이다."),
    "H-1": ("또한 비가 왔다.\n따라서, 젖었다.", 2, "하지만 간다.\n그러나 온다.\n즉, 논다.", 3, "또한 비가 왔다. 따라서 젖었다."),
    "H-2": ("갔다. 하지만 왔다. 그러나 갔다. 하지만, 왔다. 그러나 갔다.", 4, "하지만 가고 하지만 오고 하지만 자고 그러나 놀고 그러나 쉰다.", 5, "갔다. 하지만 왔다. 못하지만 갔다. 그러나 왔다. 그러나는 갔다."),
    "H-3": ("이는 옳다. 이는 크다.", 2, "갔다. 이는 옳다. 왔다! 이는 크다? 이는 멀다.", 3, "이는 옳다. 길이는 길다. 그 이는 크다."),
    "H-4": ("즉, 간다. 즉 온다.", 2, "말, 즉 뜻. 즉, 끝. 즉 시작.", 3, "즉, 간다. 즉시 온다. 연즉 간다."),
    "I-1": ("갈 것이다. 올 것이다. 볼 것이다. 할 것입니다. 살 것이다.", 5, "갈 것이다. 올 것이다. 볼 것이다. 할 것이다. 살 것이다. 줄 것입니다.", 6, "갈 것이다. 올 것이다. 볼 것이었다. 할 것입니다만. 살 것이다!"),
    "I-3": ("옳다는 것은 좋고 그르다는 점이 나쁘다.", 2, "책이라는 것을 알고 크다는 사실은 알고 작다는 점이다.", 3, "옳다는 것은 좋다. 옳다는 말은 좋다."),
    "I-4": ("검토할 필요가 있다.", 1, "준비할 필요가 있습니다. 고민할 필요가 있다.", 2, "할 필요가 있다. 볼 필요가 있다."),
    "I-5": ("대책이 필요하다. 정책이 필요하고.", 2, "시간이 필요하며 노력이 필요하다. 준비가 필요하습니다.", 3, "대책이 필요하다. 물이 필요하다."),
    "I-7": ("늦었다는 분석이다.", 1, "좋다는 평가입니다. 기회라는 해석이다.", 2, "늦었다는 분석을 했다. 좋은 평가이다."),
    "J-2": ("'하나' '둘째' '셋째' '넷째'", 4, "‘가나’와 ‘다라’와 ‘마바’와 ‘사아’와 ‘자차’", 5, "'가' '나' '다' '라'"),
    "J-3": ("가 — 나 — 다 — 라", 3, "가 — 나 — 다 — 라 — 마", 4, "가—나 — 다— 라"),
    "J-4": ("(여섯 글자다) (일곱 글자다) (여덟 글자다) (아홉 글자다)", 4, "(여섯 글자다) (일곱 글자다) (여덟 글자다) (아홉 글자다) (마지막이라네)", 5, "(짧다) (여섯 글자다) (또 짧다)"),
    "HS-1": ("솔직히 나는 잘 모르겠다.", 2, "내 생각에는 그렇다. 개인적으로는 좋다.", 2, "내 생각은 그렇다."),
    "HS-2": ("그때 왔다. 작년 겨울.", 2, "올해 초 봤다. 어제, 그해.", 3, "그때는 왔다. 어제도 봤다."),
    "HS-3": ("힘들었다. 막막했다.", 2, "짜증이 나고 귀찮고 억울하다.", 3, "힘들고 어렵다."),
    "HS-4": ("또, 갔다.", 1, "갔다. 또, 왔다. 또, 봤다.", 2, "그는 또, 갔다. 또 왔다."),
    "HS-5": ("친구를 도와준다.", 1, "알려 주는 사람이 가르쳐 줍니다.", 2, "도와준다면 좋다. 주는 사람."),
    "HS-6": ("근데 나는 그냥 갔다.", 2, "되게 크고 엄청 멀고 진짜 춥다.", 3, "그냥저냥 갔다. 막상은 그렇다."),
    "HS-7": ("나는 간다. 제가 한다.", 2, "내가 보고 저는 듣고 우리 집 간다.", 3, "하나는 크다. 나는새."),
}

#: (number, id, text, count): the cases one by one.
ROWS = [(3 * k + i, name, case[2 * i], case[2 * i + 1] if i < 2 else 0) for k, (name, case) in enumerate(CASES.items()) for i in range(3)]
