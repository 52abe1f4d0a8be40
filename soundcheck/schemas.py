"""Declared schemas of the engine's own tables."""

CHECKS = """check_id string, ord int, name string, kind string, severity string, sql string,
 table_name string, path string, filter string, field string, order_by string,
 expect_min double, expect_max double, equals string, max_age_s bigint, bool boolean,
 expect_status int, expect_body_contains string, expect_json string, url string,
 capture string, dialect string, keep_literal boolean"""

RESULTS = """check_id string, ord int, name string, ok boolean, severity string, got string,
 got_num double, got_ts timestamp, detail string, error string, keep_literal boolean"""

LOAD = "ok boolean, method string, database string, duration_ms bigint, warnings string, error string"

REPORT = f"""schema_version int, run_id string, part int, tool_version string, target string,
 started_at timestamp, finished_at timestamp, duration_ms bigint, load struct<{LOAD.replace(' boolean', ':boolean').replace(' string', ':string').replace(' bigint', ':bigint')}>,
 checks array<struct<ord:int,name:string,ok:boolean,severity:string,got:string,detail:string,error:string,keep_literal:boolean>>,
 verdict string"""

SCHEMA_VERSION = 1

CHECK_FIELDS = [f.split()[0] for f in CHECKS.replace("\n", " ").split(",")]
RESULT_FIELDS = [f.split()[0] for f in RESULTS.replace("\n", " ").split(",")]
