"""Quality statistics of scripts that have no blanks between words."""

from lingualoom.llm import text_quality as Q

PROSE = {
    "ja": "市立図書館は毎日九時に開きます。申し込みは窓口でお願いします。駅から歩いて十分です。新しいバスは来月から走ります。",
    "zh": "图书馆每天都开门，周末休息。我们已经收到了很多申请，请大家等一等。您需要在十天内到办事处提交申请吗？",
    "th": "คุณต้องยื่นคำขอภายในเดือนนี้ที่เมืองของคุณ รถเมล์วิ่งไปยังสถานีทุกวันและไม่มีค่าใช้จ่าย",
}
SPAM = {"ja": "格安通販送料無料" * 60, "zh": "便宜购物免费" * 60, "th": "ขายส่งราคาถูก" * 60}
LISTS = {"ja": "りんご\nみかん\nバナナ\nぶどう\nスイカ", "zh": "苹果\n香蕉\n橘子\n葡萄\n西瓜", "th": "กล้วย\nส้ม\nแอปเปิล\nมะม่วง\nองุ่น"}


def test_dense_scripts_are_measured():
    of = lambda text: dict(zip(Q.STATISTICS, Q.statistics(text)))
    for language, text in PROSE.items():
        prose, spam, items = of(text), of(SPAM[language]), of(LISTS[language])
        assert prose["running_share"] == 1.0 and prose["common_share"] > 0.15
        assert spam["running_share"] == 0.0 and spam["distinct_share"] < 0.1 < prose["distinct_share"]
        assert items["running_share"] < 0.5 and items["common_share"] < 0.25


def test_spam_and_lists_in_dense_scripts_are_no_prose(spark):
    texts = [*SPAM.values(), *("\n".join([x] * 6) for x in LISTS.values()), *PROSE.values()]
    rows = [(k, t) for k, (_, t) in enumerate(Q.EXAMPLES)] + [(100 + k, t) for k, t in enumerate(texts)]
    kinds = {r.doc_id: r.kind for r in Q.text_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [kinds[100 + k] == "prose" for k in range(9)] == [False] * 6 + [True] * 3
