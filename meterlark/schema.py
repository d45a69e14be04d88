"""Tables of the metering engine, as Spark schemas."""

USAGE = "key long, acct int, ts long, model string, inp long, outp long, cr long, cc long, e5 long, e1 long, tier int"
ROLLUP = "hour long, acct int, model string, tier int, inp long, outp long, cr long, cc long, e5 long, e1 long, ccx long, n long"
ACCOUNTS = "id int, provider string, identity string, label string"
LIMIT_EVENTS = "id long, acct int, kind string, window string, label string, resets_at long, at long, resumed_at long"
EVENT_LOG = "identity string, event string, window string, label string, resets_at long, at long, resumed_at long"
DROPPED = "key long, reason string, at long"
BUCKET = "struct<label:string,used_percentage:double,resets_at:double,window_minutes:double>"
CAPTURE = f"identity string, provider string, captured_at double, via string, rate_limits map<string,{BUCKET}>"

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
#: Counts at or above this are refused: they don't survive a double.
TOO_LARGE = 2**53
