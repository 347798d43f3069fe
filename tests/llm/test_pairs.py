import pytest

from sievework.llm.pairs import is_copy, is_refusal, language, pair_defects

SCHEMA = "id string, query string, answer string"
Q = "Верно ли, что ООО «Ромашка» уплачивает налог по ставке шесть процентов, если доход получен летом?"
GOOD = "Да, ООО уплачивает налог по ставке шесть процентов. Срок уплаты наступает в апреле [1]."


def defects(spark, rows):
    return {(r.id, r.defect) for r in pair_defects(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_defects(spark):
    rows = [(f"g{i}", Q, GOOD) for i in range(30)]
    rows += [
        ("e1", Q, None), ("e2", Q, " [1]​ —"), ("e3", Q, ""),
        ("t1", Q, "Срок уплаты наступает в"), ("t2", Q, "Да, ООО уплачивает налог по ставке шесть процентов, а"), ("t3", Q, "Срок уплаты насту"),
        ("r1", Q, "К сожалению, данных для ответа недостаточно. Обратитесь к специалисту."), ("n1", Q, "Не могу назвать точную сумму, однако порядок следующий. Шесть процентов."),
        ("c1", Q, Q), ("c2", Q, "Вы спросили: " + Q.upper()), ("c3", Q, Q + "\n" + Q), ("n2", Q, Q + "\nНет. [2]"), ("c4", Q, Q.replace("налог ", "")),
        ("l1", Q, "The company pays the tax at the rate of six percent in April."), ("l2", Q, "I am sorry, but I cannot answer the question."),
        ("n3", Q, "Срок уплаты наступает в апреле"), ("n4", Q, "Да, ООО уплачивает налог.\nСсылки: [1], [2]"), ("q0", None, GOOD), (None, Q, None),
    ]
    want = {("e1", "empty"), ("e2", "empty"), ("e3", "empty"), ("t1", "truncated"), ("t2", "truncated"), ("t3", "truncated"), ("r1", "refusal"), ("c1", "copied_question"), ("c2", "copied_question"), ("c3", "copied_question"), ("c4", "copied_question"), ("l1", "other_language"), ("l2", "other_language"), ("l2", "refusal")}
    assert defects(spark, rows) == want
    # Rows that come twice change nothing; columns of other names do not clash.
    twice = spark.createDataFrame([(*r, "x", 1) for r in rows * 2], SCHEMA + ", defect string, seen int")
    assert {(r.id, r.defect) for r in pair_defects(twice).collect()} == want


def test_empty_table(spark):
    assert defects(spark, []) == set()


@pytest.mark.parametrize(("text", "want"), [("Der Vertrag gilt und wird nicht geändert", "de"), ("La oficina revisa la petición y contesta", "es"), ("Заявник подає документи протягом 9 днів", "uk"), ("Службата разглежда искането и отговаря. Според договора задължението е възникнало през годината", "bg"), ("Шарт жасалғандықтан қосымша төлем", "kk"), ("До числа. Раздел «Reporting and Payments of the year»", "ru"), ("12 [1]", None)])
def test_language(text, want):
    assert language(text) == want


def test_long_answers_are_read_whole():
    assert not is_copy(Q, Q + " " + "Порядок иной. " * 3000)
    assert not is_refusal("Ответить невозможно. " + "Налог платят весной. " * 3000)


def test_heldout_refusals_and_legal_answers():
    """Precision and recall on sentences that no dictionary was filled from."""
    from tests.llm.refusals_heldout import ANSWERS, REFUSALS

    found, wrong = [x for x in REFUSALS if is_refusal(x)], [x for x in ANSWERS if is_refusal(x)]
    print(len(REFUSALS), len(found), len(ANSWERS), len(wrong))
    assert len(found) >= 0.9 * len(REFUSALS)
    assert len(found) >= 0.9 * (len(found) + len(wrong))


@pytest.mark.parametrize(("text", "want"), [("Wniosek nie został złożony w terminie.", "pl"), ("Başvuru süresi içinde yapılmadı.", "tr"), ("O pedido não foi apresentado no prazo.", "pt"), ("Заява не была пададзена ў тэрмін.", "be"), ("Захтев није поднет у року и враћа се пошиљаоцу.", "sr"), ("申告書は期限内に提出されませんでした。", "ja"), ("신고서는 기한 내에 제출되지 않았습니다.", "ko"), ("Η δήλωση δεν υποβλήθηκε εγκαίρως.", "el"), ("Уточните детали и спросите снова", "ru"), ("Verzoek niet op tijd ingediend bij de dienst en de inspectie", "nl")])
def test_languages_by_letter_groups(text, want):
    assert language(text) == want


def test_contexts_by_key(spark, monkeypatch):
    """Beyond the limit of what is sent along, the endings are joined by key."""
    from sievework.llm import pairs

    rows = [(f"g{i}", Q, GOOD) for i in range(30)] + [("t1", Q, "Срок уплаты наступает в"), ("n1", Q, "Срок уплаты наступает в апреле")]
    monkeypatch.setattr(pairs, "FEW_CONTEXTS", 0)
    assert defects(spark, rows) == {("t1", "truncated")}
