"""Benchmark items in scripts that have no spaces between words."""

from corpuslake.llm import decontam

ITEMS = [(1, "水は何度で沸騰しますか。正しい答えを選びなさい"), (2, "中国的首都是哪一座城市\u3000请选择正确的答案"), (3, "น้ำเดือดที่อุณหภูมิเท่าไร"), (4, "un\xa0deux\u2003trois\xa0quatre\xa0cinq\xa0six")]


def test_items_without_spaces_are_found(spark):
    rows = [(i, "前の文章です" + t + "and more", [i]) for i, t in ITEMS[:3]]
    rows += [(4, "avant: un deux trois quatre cinq six, apres", [4]), (5, "正しい答えを選びなさい。別の文 水は何度で沸騰しますか", [1]), (6, "请选择一座城市", []), (7, "été " * 20, []), (8, "水は低い所へ流れる", [])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.leaked_items for r in decontam.find_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got == {i: leaked for i, _, leaked in rows}
