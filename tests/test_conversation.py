from lexweave.operators import conversation


def questions(spark, *texts, most=4000):
    rows = [(str(i), "c", "user", x, i) for i, x in enumerate(texts)]
    m = spark.createDataFrame(rows, "id string, conversation_id string, role string, content string, created_at int")
    return [(r["follow_up"], r["question"]) for r in conversation.rewritten_questions(m, most).orderBy("id").collect()]


def test_questions_are_never_cut(spark):
    long, asked = "x" * 5000, "Còn phí thì sao?"
    assert questions(spark, long, asked) == [(False, long), (True, "x" * (4000 - len(asked) - 1) + "\n" + asked)]
    assert questions(spark, "Phí?", "Còn " + "y" * 4000)[1] == (True, "Còn " + "y" * 4000)
    assert questions(spark, "ab     cd", "Còn x", most=10)[1] == (True, "ab\nCòn x")


def test_follow_up_by_its_ending(spark):
    got = questions(spark, "Phí bến bao nhiêu", "Xe máy  thì sao", "Ly hôn thì sao", "Thì sao nữa")
    assert got == [(False, "Phí bến bao nhiêu"), (True, "Phí bến bao nhiêu\nXe máy  thì sao"), (False, "Ly hôn thì sao"), (False, "Thì sao nữa")]
