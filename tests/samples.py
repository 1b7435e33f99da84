"""Hand-written attempts: FIXTURES.md section 2."""

from datetime import datetime

from paywake.schema import ATTEMPT_COLUMNS, ATTEMPT_SCHEMA

CREATED = datetime(2024, 1, 7, 23, 0)  # a Sunday
NAMES = [name for name, _ in ATTEMPT_COLUMNS]


def attempt(session, seq=1, status="Failed", psp="P1", minute=1, **more):
    row = dict.fromkeys(NAMES)
    row.update(session_key=session, try_seq=seq, merchant_key="m1", category_id="c1", amount=1e6,
               try_status=status, psp_code=psp, created_at=CREATED,
               try_created_at=None if minute is None else CREATED.replace(minute=minute))
    row.update(more)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], ATTEMPT_SCHEMA)


SESSION_ROWS = [
    attempt("s1", 1, "Verified"),
    attempt("s2", 1, "Failed"), attempt("s2", 2, "Paid", "P2", 2),
    attempt("s3", 1, "Failed"), attempt("s3", 2, "Failed", "P1", 2),
    attempt("s4", 0, None, None, None),
    attempt("s5", 1, "Reversed", amount=None),
    attempt("s6", 1, "Failed"), attempt("s6", 1, "Verified", "P2", 2),
    attempt("s7", 1, None), attempt("s7", 2, "Paid", "P1", 2),
    attempt("s8", 1, "Failed", "P1", None), attempt("s8", 1, "Paid", "P2", 2),
    attempt("s9", 2, "Failed", ""), attempt("s9", 3, "Verified", "P3", 2),
    attempt("s10", 1, "Verified", "P9"), attempt("s10", 2, "Failed", "P1", 2),
]

EXPECTED_COLUMNS = ("attempt_count psp_count any_success later_success last_attempt_status last_psp_code "
                    "first_try_status first_attempt_success recovered unrecovered retried no_attempt "
                    "final_success").split()

T, F_, N = True, False, None
EXPECTED = {
    "s1": (1, 1, T, N, "Verified", "P1", "Verified", T, F_, F_, F_, F_, T),
    "s2": (2, 2, T, T, "Paid", "P2", "Failed", F_, T, F_, T, F_, T),
    "s3": (2, 1, F_, F_, "Failed", "P1", "Failed", F_, F_, T, T, F_, F_),
    "s4": (0, 0, N, N, N, N, N, F_, F_, F_, F_, T, F_),
    "s5": (1, 1, F_, N, "Reversed", "P1", "Reversed", F_, F_, T, F_, F_, F_),
    "s6": (2, 2, T, N, "Verified", "P2", "Failed", F_, F_, F_, T, F_, T),
    "s7": (2, 1, T, T, "Paid", "P1", N, F_, F_, F_, T, F_, T),
    "s8": (2, 2, T, N, "Paid", "P2", "Paid", T, F_, F_, T, F_, T),
    "s9": (2, 1, T, T, "Verified", "P3", "Failed", F_, T, F_, T, F_, T),
    "s10": (2, 2, T, F_, "Verified", "P9", "Verified", T, F_, F_, T, F_, T),
}
