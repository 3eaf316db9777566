"""DuckDB forms of the shared tables, put together as common table expressions."""

from __future__ import annotations

from ..sources.testbed import DEFINITIONS, LAST_MONTH, MONTHS, staging_sql

PERIOD = "printf('%04d-%02d', idx // 12, idx % 12 + 1)"
W3, W3B = "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW", "ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING"

#: name -> (names that it reads, SQL)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "spine": (
        ("directory", "exits"),
        f"""SELECT d.*, e.exit_idx, e.regretted, m.idx, printf('%04d-%02d', m.idx // 12, m.idx % 12 + 1) AS period, m.idx - hire_idx AS tenure, m.idx // 12 - birth_year AS age,
          coalesce(e.exit_idx > m.idx, true) AS active, coalesce(e.exit_idx - m.idx BETWEEN 1 AND 3, false) AS leaves_soon
        FROM directory d LEFT JOIN exits e USING (person_id)
        JOIN (SELECT unnest(range({LAST_MONTH - MONTHS + 1}, {LAST_MONTH + 1})) AS idx) m ON m.idx >= d.hire_idx AND (e.exit_idx IS NULL OR m.idx <= e.exit_idx)""",
    ),
    "op_month": (
        ("spine", "metrics"),
        f"""SELECT s.*, productivity, csat, days_without_leave, round(avg(productivity) OVER a, 6) AS prod_avg_3m, round(avg(productivity) OVER b, 6) AS prod_avg_3m_before,
          round(avg(productivity) OVER a - avg(productivity) OVER b, 6) + 0.0::DOUBLE AS prod_delta_3m, count(productivity) OVER a AS prod_months_3m,
          round(avg(csat) OVER a, 6) AS csat_avg_3m, round(avg(csat) OVER a - avg(csat) OVER b, 6) + 0.0::DOUBLE AS csat_delta_3m
        FROM spine s LEFT JOIN metrics USING (person_id, idx)
        WINDOW a AS (PARTITION BY person_id ORDER BY idx {W3}), b AS (PARTITION BY person_id ORDER BY idx {W3B})""",
    ),
    "ranked_reviews": (
        ("reviews",),
        "SELECT *, row_number() OVER w AS review_no, lag(score) OVER w AS score_before FROM reviews WINDOW w AS (PARTITION BY person_id ORDER BY idx, cycle)",
    ),
    "review_month": (
        ("op_month", "ranked_reviews", "first_reviews"),
        """SELECT o.*, coalesce(r.review_no, 0) AS reviews_so_far, r.score, r.score_before, o.idx - r.idx AS months_since_review,
          round(r.score - r.score_before, 6) AS score_delta, CASE WHEN idx_90 <= o.idx THEN score_90 END AS score_90
        FROM op_month o LEFT JOIN LATERAL (SELECT * FROM ranked_reviews r WHERE r.person_id = o.person_id AND r.idx <= o.idx ORDER BY review_no DESC LIMIT 1) r ON true
        LEFT JOIN first_reviews f ON f.person_id = o.person_id""",
    ),
    "dev_month": (
        ("review_month", "courses", "notes"),
        """SELECT r.*, coalesce(n.n_notes, 0) AS n_notes, coalesce(sum(c.n_courses) OVER y, 0)::BIGINT AS courses_12m, coalesce(sum(c.n_hours) OVER y, 0)::BIGINT AS hours_12m,
          coalesce(sum(n.n_notes) OVER h, 0)::BIGINT AS notes_6m, r.idx - max(CASE WHEN c.n_courses > 0 THEN r.idx END) OVER e AS months_since_course,
          r.idx - max(CASE WHEN n.n_notes > 0 THEN r.idx END) OVER e AS months_since_note
        FROM review_month r LEFT JOIN (SELECT person_id, idx, count(*) AS n_courses, sum(hours) AS n_hours FROM courses GROUP BY ALL) c USING (person_id, idx)
        LEFT JOIN (SELECT person_id, idx, count(*) AS n_notes FROM notes GROUP BY ALL) n USING (person_id, idx)
        WINDOW y AS (PARTITION BY r.person_id ORDER BY r.idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), h AS (PARTITION BY r.person_id ORDER BY r.idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
          e AS (PARTITION BY r.person_id ORDER BY r.idx ROWS UNBOUNDED PRECEDING)""",
    ),
    "p360": (
        ("dev_month", "bands"),
        """SELECT *, round(avg(courses_12m) OVER c, 6) AS courses_12m_cohort, round(avg(days_without_leave) OVER c, 6) AS leave_cohort,
          round(courses_12m / nullif(avg(courses_12m) OVER c, 0), 6) AS training_ratio, round(days_without_leave / nullif(avg(days_without_leave) OVER c, 0), 6) AS leave_ratio
        FROM (SELECT d.*, band_mid, band_min, band_max, round(salary / band_mid, 4) AS compa, coalesce(salary < band_min, false) AS under_band,
            CASE WHEN age < 26 THEN '<26' WHEN age < 36 THEN '26-35' WHEN age < 46 THEN '36-45' ELSE '46+' END AS age_band,
            CASE WHEN tenure < 12 THEN '0-11' WHEN tenure < 24 THEN '12-23' WHEN tenure < 48 THEN '24-47' ELSE '48+' END AS tenure_band
          FROM dev_month d LEFT JOIN bands USING (family, country)) WINDOW c AS (PARTITION BY idx, tenure_band)""",
    ),
}


def with_tables(final: str, *names: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """``final`` after the definitions of ``names`` and all that they read."""
    known, out = TABLES | (extra or {}), {}

    def add(name: str) -> None:
        if name in out:
            return
        if name in DEFINITIONS:
            out[name] = staging_sql(name)
            return
        for n in known[name][0]:
            add(n)
        out[name] = f"{name} AS ({known[name][1]})"

    for n in names:
        add(n)
    return "WITH " + ",\n".join(out.values()) + "\n" + final
