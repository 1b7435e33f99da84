"""The attempt table: one row per payment attempt.

Strict columns fail the job on a value that does not cast; lenient ones turn it into NULL.
Text columns without a declared cast still become strings, because the rules compare them
with '' and with status words.
"""

# Column name and type, in table order.
ATTEMPT_COLUMNS = [
    ("session_key", "string"),
    ("try_seq", "int"),
    ("terminal_key", "string"),
    ("merchant_key", "string"),
    ("category_id", "string"),
    ("category_title", "string"),
    ("amount", "double"),
    ("adjusted_fee", "double"),
    ("session_status", "string"),
    ("try_status", "string"),
    ("switch_response_code", "string"),
    ("psp_code", "string"),
    ("issuer_bank_code", "string"),
    ("payer_card_key", "string"),
    ("verify_type", "string"),
    ("init_time_ms", "double"),
    ("verify_time_ms", "double"),
    ("created_at", "timestamp_ntz"),
    ("try_created_at", "timestamp_ntz"),
    ("verified_at", "timestamp_ntz"),
    ("settled_at", "timestamp_ntz"),
    ("expire_in", "timestamp_ntz"),
]

# Timestamps are the lenient columns.
LENIENT_TYPES = {"timestamp_ntz"}

ATTEMPT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in ATTEMPT_COLUMNS)
