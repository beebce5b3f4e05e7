import random
import statistics

from coverlens.operators import fallback_medians, impute_from_medians


def test_falls_back_from_cell_to_year_to_everything(spark):
    rnd = random.Random(4)
    rows = [
        (i, rnd.choice([2018, 2018, 2019, 2020, None]), rnd.choice(["A", "A", "A", "B", None]),
         rnd.choice([-1.0, 0.79, 0.8, 2.0, 2.01, None, *[round(rnd.uniform(0.8, 2), 3) for _ in range(5)]]))
        for i in range(400)
    ]
    rows.append((400, 2031, "A", -1.0))
    frame = spark.createDataFrame(rows, "id long, yr long, seg string, ratio double")
    usable = [r for r in rows if r[3] is not None and 0.8 <= r[3] <= 2.0]
    medians = fallback_medians(frame, "ratio", ["yr", "seg"], (0.8, 2.0))
    got = {r["id"]: r["median"] for r in impute_from_medians(frame, medians, ["yr", "seg"], min_cell=30).collect()}
    for i, yr, seg, _ in rows:
        fine = [r[3] for r in usable if r[1:3] == (yr, seg)] if None not in (yr, seg) else []
        coarse = [r[3] for r in usable if r[1] == yr] if yr is not None else []
        everything = round(statistics.median(r[3] for r in usable), 6)
        large = [cell for cell in (fine, coarse) if len(cell) >= 30]
        assert abs(got[i] - (statistics.median(large[0]) if large else everything)) < 1e-12


def test_nothing_plausible_gives_null(spark):
    frame = spark.createDataFrame([(1, 2018, "A", 9.0)], "id long, yr long, seg string, ratio double")
    medians = fallback_medians(frame, "ratio", ["yr", "seg"], (0.8, 2.0))
    filled = impute_from_medians(frame, medians, ["yr", "seg"], min_cell=30)
    assert filled.first()["median"] is None
