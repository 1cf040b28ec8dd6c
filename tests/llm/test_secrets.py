import base64
import gzip
import hashlib
import re
import resource
import time
import urllib.parse
import zlib

from plenara.llm import secrets

KEY = "AKIA" + "B7" * 9
ASSIGN = "Password: 'abcdEFGH1234+/x"


def brute(text):
    kinds = [
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
        ("access", "(AKIA[A-Z0-9]+)", 1, 18), ("hex", "([0-9a-f]+)", 1, 16),
    ]
    found = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p, g, least) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    return [x for *_, x in sorted(found)]


CASES = [
    None, "", "nothing here", f"x {KEY} y", f"é {ASSIGN} and {ASSIGN}", "secret:'token: aaaaaaaaaaaaaaaa", "secret=token=aaaaaaaaaaaa", "password=short", "AKIAAKIA12",
    "deadbeef" * 4 + " DEADBEEF" * 4, "toKen=abcdefabcdefabcd", "apikey = 0123456789abcdef", "a" * 100_000 + " " + KEY, KEY, KEY,
]


def test_open_finds_equal_brute_force(spark, tmp_path):
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(CASES)], "doc_id long, text string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in secrets.op10_secret_scan(spark, str(tmp_path)).collect()}
    for i, t in enumerate(CASES):
        want = brute(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(rows[i].spans.split(","))
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(x.startswith(k) for x in want) for k in secrets.KINDS)


def unwrapped(text):
    base, spans, layers, closed = secrets.scan(text)
    return {text[a:b] for a, b, k in spans} - {text[a:b] for a, b, k in base}


def test_layers_map_back_to_the_original():
    coded = urllib.parse.quote(KEY, safe="").replace("A", "%41")
    assert unwrapped(f"see {coded} there") == {coded}
    escaped = "".join(f"\\u{ord(c):04x}" for c in KEY)
    assert unwrapped(f"é {escaped} \\x41") == {escaped}
    run = base64.b64encode(f"my key is {KEY} end".encode()).decode()
    (part,) = unwrapped(f"data {run} data")
    assert part in run and KEY.encode() in base64.b64decode(run[run.index(part) // 4 * 4 :] + "==")
    for pack in (gzip.compress, zlib.compress):
        packed = base64.b64encode(pack(f"my key is {KEY}".encode())).decode().rstrip("=")
        assert unwrapped(f"<{packed}>") == {packed}


def test_nested_layers_end_and_bombs_stay_closed():
    inner = base64.b64encode(gzip.compress(base64.b64encode(f"token={'q' * 20}".encode()))).decode()
    outer = urllib.parse.quote(inner, safe="").replace("H", "%48")
    assert unwrapped(f"x {outer} y")
    assert secrets.scan("%2525252525")[2] == 3  # as it is, unwrapped once, and to the end
    bomb = base64.b64encode(zlib.compress(b"0" * 50_000)).decode()
    assert secrets.scan(bomb, limit=10_000)[3] == 1


def test_empty_table(spark):
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_run_that_stands_twice_is_found_twice():
    plain = base64.b64encode(f"my key is {KEY} end".encode()).decode()
    for run in (plain, base64.b64encode(gzip.compress(plain.encode())).decode()):
        text = f"{run} and {run}"
        spans = [(a, b) for a, b, _ in secrets.scan(text)[1]]
        assert len(spans) == 2 and spans[0][1] <= len(run) < spans[1][0]
        assert len({text[a:b] for a, b in spans}) == 1


def test_runs_that_are_glued_wrapped_or_not_quite_text():
    whole = f"my key is {KEY} and that is all of it there is".encode()
    coded = base64.b64encode(whole).decode()
    wrapped = lambda run, n: "\r\n".join(run[i : i + n] for i in range(0, len(run), n))
    body = b"".join(bytes([97 + i * i % 26, 33 + i * 7 % 90]) for i in range(200)) + whole
    packed = base64.b64encode(gzip.compress(body)).decode()
    cases = [f"{p}{coded}" for p in ("https://h/x/", "key-", "id_", "a/", "ab/")] + [coded + "/more-of-it", wrapped(coded, 20), wrapped(packed, 64), wrapped(packed, 76)]
    cases += [f"{p}{base64.b64encode(pack(body)).decode()}" for p in ("key-", "id_", "x/") for pack in (gzip.compress, zlib.compress)]
    cases += [base64.b64encode(whole + b).decode() for b in (b" \0", b" \xff\xfe")]
    cases += [base64.b64encode(gzip.compress(b"first member") + gzip.compress(whole)).decode()]
    cases += ["%FF" + "".join(f"%{c:02x}" for c in whole)]
    for text in cases:
        assert unwrapped(f"see {text} there"), text


def test_large_streams_are_scanned_in_parts():
    for at in (5, 9_990, 10_003, 40_000):
        large = b"- " * (at // 2) + KEY.encode() + b" -" * 20_000
        base, spans, _, oversize = secrets.scan(base64.b64encode(zlib.compress(large)).decode(), limit=10_000)
        assert not base and len(spans) == 1 and oversize == 1, at
    last = zlib.compress(b"- " * 3_000_000 + KEY.encode())
    assert len(secrets.scan(base64.b64encode(last).decode(), limit=1_000_000)[1]) == 1


def test_bytes_that_are_not_text_and_other_forms():
    whole = f"my key is {KEY} and that is all"
    percent = "".join(f"%{c:02x}" for c in whole.encode())
    cases = [percent[:15] + "%FF" + percent[15:] + "%FF%C3", base64.b64encode((whole + "\x01").encode()).decode()]
    cases += [base64.b64encode(whole.encode(code)).decode() for code in ("utf-16-le", "utf-16-be", "utf-16")]
    cases += [KEY.replace("A", x, 1) for x in ("&#x41;", "&#65;", "\\U00000041", "\\u{41}", "&amp;#x41;", "%26%23x41;", "\\u0025\\u00341", "%5Cu0041")]
    cases += [base64.b64encode(("\u00e9" + KEY).encode()).decode() + "=="]
    for text in cases:
        found = unwrapped(f"see {text} there")
        assert found and all(x in text for x in found), text


def nested(text):
    """The text with every escape unwrapped, one level after the other."""
    one = re.compile(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|&#x([0-9A-Fa-f]{1,6});")
    while (new := one.sub(lambda m: chr(int(next(filter(None, m.groups())), 16)), text)) != text:
        text = new
    return text


def test_settled_layers_equal_level_after_level():
    import random

    rnd = random.Random(6)
    for _ in range(300):
        text = "".join(rnd.choice("aB4/ ") for _ in range(rnd.randrange(3, 12)))
        for _ in range(rnd.randrange(1, 6)):
            form = rnd.choice(["%{:02x}", "\\x{:02X}", "\\u{:04x}", "&#x{:x};"])
            text = "".join(form.format(ord(c)) if rnd.random() < 0.5 and ord(c) < 128 else c for c in text)
        layer = secrets._settled(secrets.Layer(text, *(secrets.np.arange(len(text)) + k for k in (0, 1))))
        assert layer.text == nested(text)
        assert len(layer.start) == len(layer.end) == len(layer.text)


def test_deep_nesting_on_long_texts_takes_linear_time():
    deep = [f"%{'25' * 500_000}41KIA{KEY[4:]}", "\\u005c" + "u005c" * 200_000 + "u0041" + KEY[1:], "&" + "amp;" * 250_000 + "#x41;" + KEY[1:], "%5Cu0025" + "5Cu0025" * 100_000 + "41" + KEY[1:]]
    for text in deep:
        started = time.process_time()
        assert unwrapped(f"see {text} there"), text[:40]
        assert time.process_time() - started < 30
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 2_000_000
