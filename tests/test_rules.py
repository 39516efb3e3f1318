"""Rules on hand-made rows, plain-Python folds, stream against batch, and plans."""

from __future__ import annotations

import datetime
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from support import SF

from millrace.functions import text as X
from millrace.functions import times, validation
from millrace.functions.nested import map_strings
from millrace.operators import accounts as A
from millrace.operators import changes as M
from millrace.operators import claims, logs
from millrace.operators import sessions as S
from millrace.plans import text_queries
from millrace.plans import views as V
from millrace.sources import tables
from millrace.streaming import streams

AT = datetime.datetime(2024, 1, 1)


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, text, rule):
    return values(spark, [(text,)], "c string", rule(F.col("c")))[0][0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail a.b+c@example.co.uk now", "mail [EMAIL_REDACTED] now"),
        ("eyJabcdefghijk.eyJabcdefghijk.sig-_9", "[JWT_REDACTED]"),
        ("sk-" + "a" * 20, "[API_KEY_REDACTED]"),
        ("sk-ant-" + "a-" * 10, "[API_KEY_REDACTED]"),
        ('Token = "' + "a1" * 20, "[SECRET_REDACTED]"),
        ("Bearer abcdefghij", "Bearer [TOKEN_REDACTED]"),
        ("PWD: 'hunter2' x", "PWD=[REDACTED] x"),
        ("api_key=" + "z" * 45, "api_[SECRET_REDACTED]"),
        ("plain text", "plain text"),
        (None, None),
    ],
)
def test_redaction(spark, text, want):
    assert one(spark, text, X.redact) == want


def test_redaction_is_the_patterns_in_order(spark):
    lines = ["password=a@b.co", "secret: " + "x" * 41, "access_token =  Bearer abcdefghijkl", "key sk-" + "q" * 25, "ſecret=" + "a" * 40]

    def plain(text):
        for pattern, replacement in X.REDACTIONS:
            text = re.sub(pattern, replacement.replace("$1", r"\1"), text)
        return text

    got = values(spark, [(line,) for line in lines], "c string", X.redact(F.col("c")))
    assert [g[0] for g in got] == [plain(line) for line in lines]


def test_redaction_of_long_runs_is_linear_and_finds_emails_after_emails(spark):
    lines = ["a" * 200_000, "x@y.co_z@w.uk", "a@b.cod@e.fg h@i.jk", "@a@b.co@c.de", "..a@b.co%c@d.ef", "é.x@y.zz"]
    began = time.perf_counter()
    got = values(spark, [(line,) for line in lines], "c string", X.redact(F.col("c")))
    assert time.perf_counter() - began < 10
    assert [g[0] for g in got] == [re.sub(X.EMAIL, "[EMAIL_REDACTED]", line) for line in lines]


def test_record_rules(spark):
    rows = [("a@b.co", "n" * 255, "user", "x" * 8), (None, None, "admin", "x" * 128), ("a@b.co\n", "n" * 256, "owner", "x" * 7)]
    checked = validation.check(spark.createDataFrame(rows, "email string, full_name string, role string, password string"), validation.account_rules())
    got = [[(e.loc, e.type) for e in r.errors] for r in checked.collect()]
    assert got == [[], [("email", "missing")], [("email", "value_error"), ("full_name", "string_too_long"), ("role", "enum"), ("password", "string_too_short")]]
    items = spark.createDataFrame([("", None), ("t", "d" * 256), (None, None)], "title string, description string")
    got = [[(e.loc, e.type) for e in r.errors] for r in validation.check(items, validation.item_rules()).collect()]
    assert got == [[("title", "string_too_short")], [("description", "string_too_long")], [("title", "missing")]]


def test_requests_without_email_come_back(spark):
    requests = spark.createDataFrame([(1, None, " A@b.co"), (2, None, None), (3, 7, "c@d.ef"), (4, None, "a@b.co")], "request_id long, account_id long, email string")
    accounts = spark.createDataFrame([(7, "c@d.ef")], "id long, email string")
    assert sorted((r.request_id, r.outcome) for r in A.conflicts(requests, accounts).collect()) == [(1, "ok"), (2, "no_email"), (3, "ok"), (4, "repeated")]


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        tables.shared_path(Session(spark_master="spark://host:7077", spark_app_id="a"), "x")
    assert tables.shared_path(Session(spark_master="local[4]", spark_app_id="a"), "x").startswith(tables.DEFAULT_SHARED_DIR)
    path = tables.shared_path(spark, "gone")
    spark.range(3).write.parquet(path)
    tables.clear_shared(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


DERBY = {"url": "jdbc:derby:memory:scan", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture
def database(spark):
    """A database in the session's own process, whose keys are far from evenly spread."""
    manager = spark._jvm.java.sql.DriverManager
    spark._jvm.java.lang.Class.forName(DERBY["driver"])
    connection = manager.getConnection(DERBY["url"] + ";create=true")
    statement = connection.createStatement()
    statement.execute("CREATE TABLE users (id BIGINT, name VARCHAR(20))")
    keys = [*range(100), 5, 5, *(10**9 + 1000 * i for i in range(20))]
    for k in keys:
        statement.execute(f"INSERT INTO users VALUES ({k}, 'n{k}')")
    statement.execute("INSERT INTO users VALUES (NULL, 'nobody'), (NULL, 'nobody')")
    yield statement, [*keys, None, None]
    statement.execute("DROP TABLE users")
    connection.close()


def test_jdbc_scan_reads_rows_once_in_even_ranges(spark, database):
    statement, keys = database
    place = {"driver": DERBY["driver"]}
    rows = tables.scan_jdbc(spark, DERBY["url"], "users", "id", 6, **place)
    assert rows.rdd.getNumPartitions() == 6 and sorted((r.ID for r in rows.collect()), key=str) == sorted(keys, key=str)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 1.5 * len(keys) / 6 and len(sizes) == 6
    assert tables.scan_jdbc(spark, DERBY["url"], "users", "id", 50, pool=3, **place).rdd.getNumPartitions() == 3
    mark = tables.high_water(spark, DERBY["url"], "users", "id", **place)
    assert tables.scan_jdbc(spark, DERBY["url"], "users", "id", above=mark, **place).count() == 0
    statement.execute(f"INSERT INTO users VALUES ({mark + 1}, 'new'), ({mark + 9}, 'newer')")
    assert sorted(r.NAME for r in tables.scan_jdbc(spark, DERBY["url"], "users", "id", above=mark, **place).collect()) == ["new", "newer"]
    assert tables.scan_jdbc(spark, DERBY["url"], "users", "id", above=90, **place).count() == 9 + 20 + 2
    statement.execute("DELETE FROM users")
    assert tables.scan_jdbc(spark, DERBY["url"], "users", "id", **place).count() == 0


JSON = [
    '{"a@b.co": "a@b.co", "n": 1.50, "e": 1e5, "x": null, "t": [true, "a@b.co"]}',
    '[[[["a@b.co", ["a@b.co"], {"k": "a@b.co"}]]]]',
    '"a@b.co"',
    '{"q": "say \\"a@b.co\\" : {", "u": "\\u00e9 a@b.co", "same": "\\u00e9"}',
    "5",
    "{}",
]


def walked(value, depth=0):
    """The rule for values of any shape."""
    if isinstance(value, str):
        return re.sub(X.EMAIL, "[EMAIL_REDACTED]", value)
    if depth >= 4:
        return value
    if isinstance(value, dict):
        return {k: walked(v, depth + 1) for k, v in value.items()}
    return [walked(v, depth + 1) for v in value] if isinstance(value, list) else value


def test_json_of_any_shape_is_redacted_by_value(spark):
    got = [g[0] for g in values(spark, [(j,) for j in [*JSON, None, "no json a@b.co"]], "c string", logs.redact_json(F.col("c")))]
    assert [json.loads(g) for g in got[: len(JSON)]] == [walked(json.loads(j)) for j in JSON]
    assert got[-2:] == [None, "no json [EMAIL_REDACTED]"] and '"n": 1.50, "e": 1e5' in got[0] and '"same": "\\u00e9"' in got[3]


def test_claims_that_are_not_valid_yet(spark):
    import base64

    token = lambda claims: "h." + base64.urlsafe_b64encode(json.dumps(claims).encode()).decode().rstrip("=") + ".s"
    now = int(AT.replace(tzinfo=datetime.UTC).timestamp())
    rows = [token({"type": "access", "exp": now + 9, "nbf": now + 5}), token({"type": "access", "exp": now, "nbf": now}), token({"type": "access", "exp": now + 1})]
    got = claims.audit(spark.createDataFrame([(r,) for r in rows], "token string"), F.lit(AT)).collect()
    assert {r.state: r.n for r in got} == {"not_yet_valid": 1, "expired": 1, "valid": 1}


def test_nested_redaction_walks_four_containers(spark):
    mail = "a@b.co"
    df = spark.createDataFrame([([[[[mail]]]], [[[[[mail]]]]], None)], "four array<array<array<array<string>>>>, five array<array<array<array<array<string>>>>>, s struct<x:string>")
    row = df.select(*[map_strings(F.col(f.name), f.dataType, X.redact).alias(f.name) for f in df.schema]).first()
    assert row.four == [[[["[EMAIL_REDACTED]"]]]]
    assert row.five == [[[[[mail]]]]]
    assert row.s is None


@pytest.mark.parametrize(
    "text, want",
    [("x" * 63 + "\ny", None), ("ab\r\nc", None), ("ab\x85c", None), ("  ab-1_  ", "ab-1_"), ("a b", None), ("", None), (None, None), ("é²", "é²"), ("x" * 70, "x" * 64), (" " + "y" * 63 + "!z", None)],
)
def test_request_id(spark, text, want):
    assert one(spark, text, X.request_id) == want


def test_request_id_ascii_only(spark):
    assert one(spark, "é", lambda c: X.request_id(c, ascii_only=True)) is None


def test_strip_takes_all_white_space(spark):
    assert one(spark, " \t A@B.CO \n", X.normalize_email) == "a@b.co"


def test_search(spark):
    rows = [(1, "axb@e.co", None), (2, "z@e.co", "A\\B"), (3, "y@e.co", None)]
    df = spark.createDataFrame(rows, "id long, email string, full_name string")
    ids = lambda text: sorted(r.id for r in A.search(df, text).collect())
    assert ids("A_B") == [1, 2]
    assert ids("a\\b") == [2]
    assert ids("") == ids(None) == [1, 2, 3]


@pytest.mark.parametrize("skip, limit, text", [(-1, 10, ""), (0, 0, ""), (0, 201, ""), (0, 10, "x" * 256)])
def test_page_bounds(spark, skip, limit, text):
    with pytest.raises(ValueError):
        A.page(V.accounts(spark, SF), text, skip, limit)


def test_empty_page_keeps_the_total(spark):
    row = A.page_with_total(V.accounts(spark, SF), "", 100000, 10).collect()
    assert [(r.total, r.id) for r in row] == [(150, None)]


def test_unknown_role_is_an_error(spark):
    df = spark.createDataFrame([("owner",)], "role string")
    with pytest.raises(Exception, match="not a role"):
        A.typed_role(df).collect()


def test_iso(spark):
    rows = [(AT,), (AT.replace(microsecond=5),), (datetime.datetime(1969, 12, 31, 23, 59, 59, 250000),)]
    got = values(spark, rows, "t timestamp", times.iso(F.col("t")))
    assert [g[0] for g in got] == [r[0].replace(tzinfo=datetime.UTC).isoformat() for r in rows]


def test_error_message(spark):
    bodies = ['{"detail":[{"msg":"m"}]}', '{"detail":"d"}', '{"detail":[]}', "{}", "no json", None]
    got = values(spark, [(b,) for b in bodies], "c string", X.error_message(F.col("c"), "default"))
    assert [g[0] for g in got] == ["m", "d", "[]", "default", "default", "default"]


def test_lists_and_labels(spark):
    assert one(spark, " a, ,b,", X.parse_list) == ["a", "b"]
    assert one(spark, '["a"]', X.parse_list) == ['["a"]']
    assert one(spark, "ada  lovelace", X.initials) == "A"
    assert one(spark, "Ünï Test  x!", X.slug) == "n-test-x"


def test_query_string(spark):
    df = spark.createDataFrame([("a b+~'", ["x", None, "y&"], {"k": "1", "n": None}, None)], "s string, l array<string>, m map<string,string>, n string")
    parameters = {"s": (F.col("s"), "scalar"), "l": (F.col("l"), "array"), "m": (F.col("m"), "map"), "n": (F.col("n"), "scalar")}
    assert df.select(X.query_string(parameters)).first()[0] == "?s=a%20b%2B~'&l=x&l=y%26&m%5Bk%5D=1"
    assert df.select(X.query_string({"n": (F.col("n"), "scalar")})).first()[0] == ""


def test_template_keeps_unknown_placeholders(spark):
    assert one(spark, None, lambda c: X.fill(F.lit("/{a}/{b}"), {"a": c})) == "//{b}"
    both = lambda template: (lambda c: X.fill(F.lit(template), {"id": c, "owner": F.lit("x y/z")}))
    assert one(spark, "{owner}", both("/a/{id}/{owner}")) == "/a/{owner}/x y/z"
    assert one(spark, "1", both("{id}{id}")) == "11" and one(spark, "1", both("plain")) == "plain" and one(spark, "1", both("")) == ""
    assert one(spark, "a b?{}%", lambda c: X.fill(F.lit("/{id}"), {"id": c}, encode=X.encode_uri)) == "/a%20b?%7B%7D%25"
    assert one(spark, "/{id}/{no}", lambda c: X.fill(c, {"id": F.lit("7")})) == "/7/{no}"


def test_uri_encoding_keeps_what_separates_parts(spark):
    marks = ";,/?:@&=+$-_.!~*'()#"
    assert one(spark, marks, X.encode_uri) == marks and one(spark, 'é "%2F<>', X.encode_uri) == "%C3%A9%20%22%252F%3C%3E"


def test_query_string_of_nested_values(spark):
    df = spark.createDataFrame([({"a b": [{"x": 1, "y": None}, {"x": 2, "y": ["p", None]}]},)], "v map<string,array<struct<x: int, y: array<string>>>>")
    got = df.select(X.query_string({"k[": (F.col("v"), df.schema["v"].dataType)})).first()[0]
    assert got == "?k%5B%5Ba%20b%5D%5Bx%5D=1&k%5B%5Ba%20b%5D%5Bx%5D=2&k%5B%5Ba%20b%5D%5By%5D=p"


def test_edges_and_tokens_in_long_runs_are_linear(spark):
    lines = ["a" + " " * 200_000 + "b", " \u2003\x85a\n b\t ", "", "   ", "eyJ" * 70_000]
    began = time.perf_counter()
    assert [g[0] for g in values(spark, [(line,) for line in lines], "c string", X.strip(F.col("c")))] == [line.strip() for line in lines]
    assert one(spark, "eyJ" * 70_000 + ".eyJ", X.redact) == "eyJ" * 70_000 + ".eyJ"
    assert time.perf_counter() - began < 5


def test_tokens_are_found_where_the_plain_pattern_finds_them(spark):
    random.seed(4)
    part = lambda: "".join(random.choice(["eyJ", "eyJ" + "a" * 10, "eyJ" + "c" * 11 + ".", "." + "eyJ" + "d" * 10 + ".e", "b" * 6, ".", " ", "-", "é"]) for _ in range(12))
    lines = [part() for _ in range(400)] + ["x.eyJaaaaaaaaaa.eyJbbbbbbbbbb.c", "eyJaeyJaaaaaaaaaa.eyJbbbbbbbbbb.c.eyJaaaaaaaaaa.eyJbbbbbbbbbb.c"]
    got = [g[0] for g in values(spark, [(line,) for line in lines], "c string", X.redact(F.col("c")))]
    plain = [re.sub(X.JWT, "[JWT_REDACTED]", line) for line in lines]
    assert got == plain and sum("[JWT" in p for p in plain) > 20


def test_patches_fold_in_order_and_stamp_real_changes(spark):
    table = spark.createDataFrame([(1, "n", "user", None), (2, "n", "user", None)], "id long, full_name string, role string, updated_at timestamp")
    rows = [(1, 1, ["role"], None, "admin"), (1, 2, ["role", "full_name"], None, None), (2, 1, ["role"], None, "user")]
    patches = spark.createDataFrame(rows, "id long, arrival long, set_fields array<string>, full_name string, role string")
    got = {r.id: r for r in M.patch(table, patches, ["full_name", "role"], F.lit(AT)).collect()}
    assert (got[1].full_name, got[1].role, got[1].updated_at) == (None, "admin", AT)
    assert (got[2].full_name, got[2].role, got[2].updated_at) == ("n", "user", None)


def fold(rows, limit, window):
    """The limiter row by row."""
    state, out = {}, {}
    for at, client, key in sorted(rows, key=lambda r: (r[0], r[2])):
        start, hits = state.get(client, (None, 0))
        if start is None or at - start >= window:
            start, hits = at, 0
        allowed = hits < limit
        out[key] = (allowed, 0 if allowed else max(1, -((at - start - window) // 1_000_000)))
        state[client] = (start, hits + allowed)
    return out


def test_rate_limit_equals_fold_by_row(spark):
    random.seed(1)
    rows = [(random.randrange(200) * 250_000, random.choice([1, 1, 1, 2, 3]), i) for i in range(400)]
    df = spark.createDataFrame([(i, c, AT + datetime.timedelta(microseconds=t)) for t, c, i in rows], "id long, client long, ts timestamp")
    for limit, window in ((3, 5), (1, 60), (300, 60)):
        got = {r.id: (r.allowed, r.retry_after) for r in S.rate_limit(df, limit, window).collect()}
        assert got == fold(rows, limit, window * 1_000_000)


def test_rate_limit_of_nothing_and_nobody(spark):
    df = spark.createDataFrame([(1, None, AT), (2, None, AT)], "id long, client long, ts timestamp")
    assert sorted((r.id, r.allowed) for r in S.rate_limit(df, 1, 60).collect()) == [(1, True), (2, False)]
    assert S.rate_limit(df.limit(0), 1, 60).count() == 0


@pytest.mark.parametrize("kind", ["limit", "sessions"])
def test_stream_equals_batch_in_any_order_within_the_delay(spark, tmp_path, kind):
    random.seed(2)
    kinds = ["login", "refresh", "refresh", "logout", "logout_all"]
    rows = [(i, i % 3, random.randrange(2), AT + datetime.timedelta(seconds=7 * i), random.choice(kinds), i % 7 == 0) for i in range(240)]
    schema = "id long, user_id long, session long, ts timestamp, kind string, stale boolean"
    for part in range(4):
        piece = rows[60 * part : 60 * part + 60]
        random.shuffle(piece)
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    batch = spark.createDataFrame(rows, schema)
    if kind == "limit":
        pick = ["id", F.col("user_id").alias("client"), "ts"]
        feed, want = feed.select(*pick), S.rate_limit(batch.select(*pick), 2, 60)
        got = streams.drain(lambda rows: streams.rate_limited(rows, 2, 60, "10 minutes"), feed, kind, "ts")
    else:
        want = S.session_fold(batch)
        got = streams.drain(lambda rows: streams.sessions_folded(rows, "10 minutes"), feed, kind, "ts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_long_titles_and_payloads_are_not_cut(spark, tmp_path):
    long = "a" * 12_000
    spark.read.parquet(f"{SF}/orders.parquet").limit(1).withColumn("o_orderpriority", F.lit(long)).write.parquet(str(tmp_path / "orders.parquet"))
    events = spark.read.parquet(f"{SF}/events.parquet").limit(1).withColumns({"event_id": F.lit(10).cast("long"), "props": F.lit(long)})
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert f"&tag={long}" in text_queries.query_strings(spark, str(tmp_path)).first().query
    assert text_queries.parse_payload(spark, str(tmp_path)).first().corrupt == long + "}x"


def test_batches_replace_their_replays(spark, tmp_path):
    df = spark.range(5)
    tables.write_batch(df.filter("id < 3"), str(tmp_path), "7")
    assert tables.write_batch(df, str(tmp_path), "7").count() == 5
    tables.write_batch(spark.range(2), str(tmp_path), "8")
    assert tables.read_batches(spark, str(tmp_path)).count() == 7
    broken = df.withColumn("id", F.when(F.col("id") == 4, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="half-way"):
        tables.write_batch(broken, str(tmp_path), "7")
    assert sorted(r.id for r in tables.read_batches(spark, str(tmp_path)).collect()) == [0, 0, 1, 1, 2, 3, 4]  # as before


def test_claims_that_cannot_be_read(spark):
    df = spark.createDataFrame([("x",), (None,), ("a.!!.c",), ("a.e30.c",)], "token string")
    assert [(r.type, r.state, r.n) for r in claims.audit(df, F.lit(AT)).collect()] == [(None, "unreadable", 4)]


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans(spark):
    accounts = V.accounts(spark, SF)
    assert "TakeOrderedAndProject" in plan_of(A.page(accounts, "x", 10, 5))
    paged = plan_of(A.number_pages(accounts.select("id", "created_at"), [F.desc("created_at"), F.asc("id")], 25))
    windows = [part for part in re.split(r"\n\n\n?(?=\()", paged) if re.match(r"\(\d+\) Window\b", part.strip())]
    assert any("_range" in w and "_row" in w for w in windows)  # rows are numbered within a range; one row per range in one task
    looked_up = plan_of(spark.read.parquet(f"{SF}/customer.parquet").filter("c_custkey = 5").select("c_name"))
    assert "EqualTo(c_custkey,5)" in looked_up and "struct<c_custkey:bigint,c_name:string>" in looked_up


def test_a_pattern_that_cannot_match_is_not_tried():
    """The outcome is that of trying all patterns; texts without what a pattern needs do not reach it."""
    rules = logs._plain_rules()
    tried = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def sub(self, replacement, text):
            tried.append(self.pattern.pattern)
            return self.pattern.sub(replacement, text)

    counted = [(Counted(p), r) for p, r in rules]
    plain = "no personal data: nothing = here " * 50
    assert logs.redact_text_value(plain, counted) == plain and tried == []
    long = "x" * 44
    texts = [f"a@b.co paſſword={long}", f"PASSWORD : {long}", f"authorİzation {long}", f"authorızation={long}", f"toKen: {long}", f"ä APİ_key=1", "Pwd:2", "Bearer " + long, "sk-" + long, "sk-ant-" + long, f"eyJ{long}.eyJ{long}.s", "token", "secret_KEY = a@b.co"]
    for text in texts:
        want = text
        for pattern, replacement in rules:
            want = pattern.sub(replacement, want)
        assert logs.redact_text_value(text, rules) == want, text
    for text in ['{"a": "x\\"y", "b": "\\\\", "c": ["\\u0041@b.co"]}', '{"a\\"" : "q\nr"}', '["a@b.co", "open']:
        slow = re.compile(r'"(?:[^"\\]|\\.)*+"(\s*+:)?|[{}\[\]]', re.DOTALL)
        assert [(m[0], m[1]) for m in logs._TOKEN.finditer(text)] == [(m[0], m[1]) for m in slow.finditer(text)]
