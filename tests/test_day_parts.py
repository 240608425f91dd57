from colligo.operators import clustering


def test_starts_by_rule(spark):
    """Four fixed parts, named after the mean of their starts; a part around midnight may so be named after the middle of the day."""
    starts = ["04:59", "05:00", "11:59", "12:00", "16:59", "17:00", "20:59", "21:00", "23:30", None, "x"]
    got = clustering.enrich(spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "id int, shift_start string"), by_rule=True).orderBy("id").collect()
    assert [r["shift_cluster_id"] for r in got] == [3, 0, 0, 1, 1, 2, 2, 3, 3, -1, -1]
    assert [r["shift_detection_confidence"] for r in got] == [1.0] * 9 + [0.0] * 2
    means = {3: (299 + 1260 + 1410) / 3, 0: (300 + 719) / 2, 1: (720 + 1019) / 2, 2: (1020 + 1259) / 2}
    name = lambda m: [n for low, n in clustering.BANDS if low <= int(m)][-1]
    assert [r["detected_shift_type"] for r in got] == [name(means[r["shift_cluster_id"]]) if r["shift_cluster_id"] >= 0 else "UNKNOWN" for r in got]
    few = clustering.enrich(spark.createDataFrame([(1, "05:00")], "id int, shift_start string"), by_rule=True).first()
    assert (few["shift_cluster_id"], few["detected_shift_type"]) == (-1, "UNKNOWN")
