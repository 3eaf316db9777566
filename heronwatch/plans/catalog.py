"""The rule catalogue: what is a signal, which signals together make an alert, and where it goes.

A signal is an expression over the person-month table with its threshold as ``{t}``; its
sentence may show columns. A rule needs all of ``all`` and, if there, any of ``any``.

Signals look at five sides of a month: learning, voice (what people write), output, standing
(reviews and raises) and pace. Thresholds are set by the distributions of the test data, whose
shipments and orders stand in for work: about one month in ten shows any one signal.
"""

from __future__ import annotations

#: The channel with a quota; the others are panels without one.
ALERT = "visit"

CATALOG = {
    "version": "2.0.0",
    "universe": "active AND tenure >= 4",
    "forbidden": ["name", "gender", "birth_year", "age", "age_band", "family", "country", "area", "mode", "exit_idx", "leaves_soon", "regretted"],
    "signals": {
        "silent": {"dimension": "voice", "kind": "risk", "expr": "notes_6m = 0 AND months_since_note >= {t}", "t": 9, "label": "Has gone silent", "says": ("Last note was %.0f months ago.", ["months_since_note"])},
        "outspoken": {"dimension": "voice", "kind": "context", "expr": "notes_6m >= {t}", "t": 1, "label": "Writes of late", "says": ("%.0f notes in half a year.", ["notes_6m"])},
        "learning_stalls": {"dimension": "learning", "kind": "risk", "expr": "months_since_course > {t}", "t": 14, "label": "Learning has stalled", "says": ("No course for %.0f months.", ["months_since_course"])},
        "learning_thin": {"dimension": "learning", "kind": "risk", "expr": "training_ratio < {t}", "t": 0.25, "label": "Learns less than the cohort", "says": ("Has taken %.0f courses in a year, the cohort %.1f.", ["courses_12m", "courses_12m_cohort"])},
        "keen": {"dimension": "learning", "kind": "context", "expr": "training_ratio > {t} AND hours_12m > 10", "t": 1.75, "label": "Learns more than the cohort", "says": ("%.0f hours of courses in a year.", ["hours_12m"])},
        "output_uneven": {"dimension": "output", "kind": "risk", "expr": "abs(round(productivity - prod_avg_3m, 6)) > {t}", "t": 11, "label": "Output swings", "says": ("Output of %.1f against a mean of %.1f.", ["productivity", "prod_avg_3m"])},
        "output_sinks": {"dimension": "output", "kind": "risk", "expr": "prod_delta_3m < {t} AND prod_months_3m > 1", "t": -14, "label": "Output sinks", "says": ("The mean of a quarter moved by %.1f.", ["prod_delta_3m"])},
        "service_cold": {"dimension": "output", "kind": "risk", "expr": "csat_avg_3m < {t}", "t": 2.2, "label": "Customers are cold", "says": ("Customers give %.2f of 5.", ["csat_avg_3m"])},
        "review_late": {"dimension": "standing", "kind": "risk", "expr": "months_since_review > {t}", "t": 12, "label": "Review is overdue", "says": ("%.0f months since a review.", ["months_since_review"])},
        "review_slips": {"dimension": "standing", "kind": "risk", "expr": "score_delta < {t}", "t": -0.55, "label": "Review slipped", "says": ("From %.2f to %.2f.", ["score_before", "score"])},
        "raise_late": {"dimension": "standing", "kind": "risk", "expr": "months_since_raise > {t}", "t": 24, "label": "No raise for two years", "says": ("Last raise was %.0f months ago.", ["months_since_raise"])},
        "well_judged": {"dimension": "standing", "kind": "context", "expr": "score > {t} AND reviews_so_far > 1", "t": 2.4, "label": "Judged well, more than once", "says": ("Review %.2f after %.0f reviews.", ["score", "reviews_so_far"])},
        "no_pause": {"dimension": "pace", "kind": "risk", "expr": "leave_ratio > {t}", "t": 1.55, "label": "Goes on without a pause", "says": ("%.0f days without leave.", ["days_without_leave"])},
    },
    #: Looked at for the lift table only; no rule reads them.
    "discarded": {
        "first_score_weak": "score_90 < 2.0 AND tenure < 18",
        "far_over_the_middle": "compa > 1.6",
        "service_jumps": "abs(csat_delta_3m) > 0.6",
    },
    "rules": {
        "silent_and_slipping": {"name": "Silent and slipping", "channel": "visit", "priority": 10, "level": "red", "all": ["silent"], "any": ["review_slips", "output_sinks"], "reading": "Someone who used to write has stopped, and results follow.", "action": "Visit in person this week. Bring no agenda: listen."},
        "sprint_without_end": {"name": "A sprint without an end", "channel": "visit", "priority": 20, "level": "red", "all": ["no_pause", "output_uneven"], "any": [], "reading": "Months without a pause, and output swings.", "action": "Fix a date for leave first. Then share out the work."},
        "cold_counter": {"name": "Cold counter", "channel": "visit", "priority": 30, "level": "amber", "all": ["service_cold"], "any": ["review_late", "silent", "learning_thin"], "reading": "Customers are cold and nobody has looked.", "action": "Sit in for an hour. Ask what gets in the way."},
        "overlooked": {"name": "Good and overlooked", "channel": "reward", "priority": 40, "level": "amber", "all": ["well_judged"], "any": ["learning_stalls", "no_pause"], "reading": "Judged well again and again, and left alone.", "action": "Name one next step. Put it in writing."},
        "keen_and_waiting": {"name": "Keen and waiting", "channel": "reward", "priority": 50, "level": "blue", "all": ["keen", "raise_late"], "any": [], "reading": "Learns more than the others and waits for a raise.", "action": "Take it to the next pay round."},
        "stuck": {"name": "Stuck", "channel": "mentor", "priority": 60, "level": "blue", "all": ["learning_stalls"], "any": ["raise_late", "review_late", "output_sinks"], "reading": "Neither learning nor standing moves.", "action": "Offer a mentor. Agree on one course."},
        "said_and_not_heard": {"name": "Said and not heard", "channel": "mentor", "priority": 70, "level": "blue", "all": ["outspoken"], "any": ["review_late", "service_cold"], "reading": "Writes, and nothing has come of it.", "action": "Read the notes together: answer each."},
    },
    "channels": {
        "visit": {"mode": "alert", "quota": 24, "cooldown": 4, "to": "Lead of the area"},
        "reward": {"mode": "panel", "quota": None, "cooldown": 2, "to": "Pay round"},
        "mentor": {"mode": "panel", "quota": None, "cooldown": 0, "to": "Mentors"},
    },
}
