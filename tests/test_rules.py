import copy

import pytest
from pyspark.sql import functions as F

from heronwatch.operators import rules
from heronwatch.plans.catalog import ALERT, CATALOG


def broken(change):
    c = copy.deepcopy(CATALOG)
    change(c)
    return c


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (lambda c: c["signals"]["keen"].update(expr="gender = 'F'"), "gender"), (lambda c: c["rules"]["cold_counter"].update(any=["nothing"]), "unknown signals"),
        (lambda c: c["rules"]["cold_counter"].update(any=[]), "one dimension"), (lambda c: c["rules"]["cold_counter"].update(all=[]), "no signal"),
        (lambda c: c["rules"]["cold_counter"].update(priority=20), "share a priority"), (lambda c: c["rules"]["cold_counter"].update(channel="x"), "channel"), (lambda c: c["channels"][ALERT].update(quota=None), "quota"),
    ],
)
def test_catalog_guarantees(change, said):
    rules.check_catalog(CATALOG)
    with pytest.raises(rules.CatalogError, match=said):
        rules.check_catalog(broken(change))


def test_cooldown_and_quota(spark):
    months = [("a", i, 3) for i in range(1, 7)] + [("b", 1, 3), ("b", 5, 3), ("c", 1, 3), ("c", 2, 1), ("d", 1, 3), ("e", 1, 3)]
    rows = spark.createDataFrame([(p, i, f"m{i}", ALERT, r, None if p == "e" else 0.5) for p, i, r in months], "person_id string, idx int, period string, channel string, priority int, compa double")
    catalog = copy.deepcopy(CATALOG)
    catalog["channels"][ALERT] |= {"quota": 2, "cooldown": 3}
    kept = rules.with_previous(rows).where(rules.past_cooldown(rules.by_channel(catalog, "cooldown", "int")))
    out = {(r.person_id, r.idx): r for r in rules.queued(kept, catalog).collect()}
    assert sorted(out) == [("a", 1), ("b", 1), ("b", 5), ("c", 1), ("c", 2), ("d", 1), ("e", 1)]  # a run stays silent after its first month
    assert [out[p, 1].state for p in "abcde"] == ["notified", "notified", "waiting", "waiting", "waiting"]
    assert [out[p, 1].position for p in "abcde"] == [1, 2, 3, 4, 5]  # ids decide, unknown pay comes last


def test_later_rows_change_nothing_before(spark, small):
    from heronwatch.operators import person_month as pm
    from heronwatch.plans.people import FACTS
    from heronwatch.sources.testbed import LAST_MONTH, staging

    t = {n: staging(spark, small, n) for n in ("directory", "exits", "bands", *FACTS)}
    cut = LAST_MONTH - 6

    def table(cut_at):
        own = {n: df.where(F.col("idx") <= cut_at) if "idx" in df.columns else df for n, df in t.items()}
        rows = pm.person_360(own["directory"], own["exits"], own["bands"], *[own[n] for n in FACTS], LAST_MONTH, 48)
        return rows.where(F.col("idx") <= cut)

    a, b = table(LAST_MONTH), table(cut)
    assert a.exceptAll(b.select(a.columns)).count() == 0 and a.count() == b.count()


def test_two_proportions(spark):
    from heronwatch.operators.fairness import two_proportions

    one = spark.range(1).select(*[two_proportions(*[F.lit(float(v)) for v in vs]).alias(n) for n, vs in {"zero": (0, 10, 0, 20), "none": (1, 0, 1, 5), "some": (30, 100, 10, 100)}.items()]).first()
    assert one.zero == 0 and one.none == 0 and one.some == pytest.approx(3.5355, abs=1e-3)
