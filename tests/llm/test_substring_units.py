"""Repeats of lines under six words, and in scripts without spaces."""

from tessera.llm import substring_dedup


def test_short_lines_and_unspaced_scripts_go(spark):
    menu = "".join(f"dish {k} with rice\n" for k in range(14))
    chinese = "河流把泥沙带到三角洲并在那里沉积下来。潮水每天两次淹没低处的田野和道路。"
    thai = "แม่น้ำพัดพาตะกอนไปยังปากแม่น้ำทุกวัน\n"
    texts = [f"first line\n{menu}end", f"other\n\n{menu}last words", f"甲。\n{chinese}", f"a b\n{chinese}", thai, "x\n" + thai, "one two\nthree", "one two\nthree"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["dedup"]["text"] for r in substring_dedup.dedup(docs).collect()}
    assert got == {0: texts[0], 1: "other\n\nlast words", 2: texts[2], 3: "a b\n", 4: thai, 5: "x\n", 6: texts[6], 7: texts[7]}


def test_windows_overlap_and_every_line_stays_once(spark, tmp_path):
    texts = ["a b c\nd e f\ng h i\n", "d e f\ng h i\nj k l\n", "g h i\nj k l\nd e f\n", "x y z\n" * 5, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in substring_dedup.query(spark, str(tmp_path)).collect()}
    assert [got[k]["text"] for k in range(5)] == [texts[0], "j k l\n", "", "x y z\n", None]  # "d e f" stands three times
    assert [got[k]["chars_removed"] for k in range(5)] == [0, 12, 18, 24, 0]


def test_a_short_line_goes_where_it_stands_often(spark):
    line = "Subscribe to our newsletter today\n"
    texts = [line + "a b\n", "c d\n" + line, line.upper(), "e f\n", "e f\n", line * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["dedup"]["text"] for r in substring_dedup.dedup(docs).collect()}
    assert got == {0: texts[0], 1: "c d\n", 2: "", 3: "e f\n", 4: "e f\n", 5: ""}
    both = {r["doc_id"]: r["dedup"]["text"] for r in substring_dedup.dedup(docs, short_repeats=2).collect()}
    assert both == {**got, 4: ""}
