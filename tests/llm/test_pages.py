"""WARC packages and page differencing, against zipfile, a plain LCS and round trips."""

import base64
import hashlib
import io
import itertools
import random
import zipfile

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from cadenza.llm import page_diff, warc_zip

ROWS = [(3, "http://a/é", "<p>same</p>"), (1, "http://b/", "<p>same</p>"), (2, None, ""), (4, "u\r\nx: y", None), (5, "http://c", "x" * 300_000), (6, "http://d", "é퟿\n\r\n\r\n"), (None, "http://e", "<p>same</p>"), (None, "http://f", "alone"), (1, "http://b/", "<p>same</p>")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))


def packages(spark, rows=ROWS, parts=2):
    return warc_zip.write_packages(pages(spark, rows).repartition(parts), warc_zip.new_folder(spark))


def test_round_trip(spark):
    got = warc_zip.read_packages(packages(spark), payload=True).collect()
    assert len(got) == len(ROWS)
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, u, h in ROWS:
        raw = (h or "").encode()
        f = first.get(h or "")
        r = f if f is not None and i != f else None
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if r is None else "revisit", r, None if r is not None else raw))
    have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_small_payloads_are_all_responses(spark):
    p = warc_zip.write_packages(pages(spark), warc_zip.new_folder(spark), least=12)
    assert {r["record_type"] for r in warc_zip.read_packages(p).collect()} == {"response"}


def test_no_rows(spark):
    p = packages(spark, [])
    assert p.count() == 0 and warc_zip.read_packages(p).count() == 0


def test_rolling_makes_more_packages(spark, monkeypatch):
    rows = [(k, f"http://h/{k}", "y" * k) for k in range(60)]
    monkeypatch.setattr(warc_zip, "ROLL_BYTES", 2000)
    p = warc_zip.write_packages(pages(spark, rows).coalesce(1), warc_zip.new_folder(spark))
    assert p.count() > 3
    assert sorted((r["page_id"], r["payload_bytes"]) for r in warc_zip.read_packages(p).collect()) == [(k, k) for k in range(60)]


def test_zipfile_reads_our_packages(spark):
    path = packages(spark, parts=1).first()["path"]
    fs, name = pafs.FileSystem.from_uri(path)
    with zipfile.ZipFile(name) as z:
        assert z.testzip() is None
        assert sorted(z.namelist()) == sorted([warc_zip.DATA, warc_zip.INDEX])
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


class Memory(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


@pytest.mark.parametrize(("zip64", "comment"), itertools.product([False, True], [b"", b"PK\x05\x06 a comment " * 9]))
def test_we_read_zipfile_packages(zip64, comment):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = comment
        for k, name in enumerate(["a.txt", "é/b.bin", "c"]):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(bytes([k]) * (k * 1000 + 1))
        z.writestr(zipfile.ZipInfo("packed"), b"z" * 999, zipfile.ZIP_DEFLATED)
    ranges = warc_zip.Ranges(Memory(out.getvalue()))
    found = warc_zip.directory(ranges)
    assert sorted(found) == sorted(["a.txt", "é/b.bin", "c"])
    assert ranges.read(*found["é/b.bin"]) == b"\x01" * 1001


def test_own_writer_is_zip64():
    out = io.BytesIO()
    z = warc_zip.StoredZip(out)
    for name in ("a", "b"):
        z.begin(name)
        z.write(name.encode() * 10)
        z.end()
    z.close()
    raw = out.getvalue()
    assert b"PK\x06\x06" in raw and b"PK\x06\x07" in raw
    r = warc_zip.Ranges(Memory(raw))
    assert r.read(*warc_zip.directory(r)["b"]) == b"b" * 10


def test_faults_are_errors():
    with pytest.raises(warc_zip.ZipError):
        warc_zip.directory(warc_zip.Ranges(Memory(b"no zip here" * 10)))
    good = warc_zip.record(1, "http://a", b"payload", warc_zip.digest(b"payload"), None)
    assert warc_zip.parse(good)["payload"] == b"payload"
    with pytest.raises(warc_zip.WarcError):
        warc_zip.parse(warc_zip.record(1, "http://a", b"payload", warc_zip.digest(b"other"), None))


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(14))] for _ in range(2))
        got = page_diff.shared_lines(a, b)
        kept = [x for x, s in zip(a, got) if s]
        assert len(kept) == lcs_length(a, b)
        it = iter(b)
        assert all(x in it for x in kept)
        by_bits = list(page_diff._common_by_bits(a, b))
        assert len(by_bits) == len(kept) and by_bits == sorted(set(by_bits))
        it = iter(b)
        assert all(a[i] in it for i in by_bits)


def test_lines_that_repeat_thousands_of_times():
    rng = random.Random(3)
    a, b = ([rng.choice(["x", "y"]) for _ in range(20_000)] for _ in range(2))
    kept = [x for x, s in zip(a, page_diff.shared_lines(a, b)) if s]
    it = iter(b)
    assert all(x in it for x in kept) and len(kept) > 16_000


def test_lines_and_zones():
    page = '<body><nav>x</nav><div class="cookie-notice">c<div>d</div>e</div><p>hi <b>yo</b> &lt;a&gt;<p>z<script>var a="</p>"</script><article><h1>T</h1><p>A&nbsp;b\n c<br>d<div class=share>s</div><aside>k</aside>u<!-- c --></article>tail<footer>f'
    assert page_diff.lines_of(page) == ["-x", "-c", "-d", "-e", "ohi yo <a>", "oz", "mT", "mA b c d", "-s", "-k", "mu", "otail", "-f"]
    assert page_diff.main_text(page_diff.lines_of(page))[0] == "hi yo <a> z T A b c d u tail"
    assert page_diff.main_text(page_diff.lines_of(page), ["oz", "mT", "otail"])[0] == "hi yo <a> T A b c d u"
    heading = '<header>s</header><article><header class="entry-header"><h1>T</h1></header><nav>n</nav>b<div class="article-share">x'
    assert page_diff.lines_of(heading) == ["-s", "mT", "-n", "mb", "-x"]
    assert page_diff.lines_of(None) == page_diff.lines_of("") == []
    assert page_diff.lines_of("a<p>&amp;&copy &am") == ["oa", "o&© &am"]


def test_neighbours_frames_go(spark):
    frame = lambda body: f"<div>Site name</div><div>Menu of things</div><div>{body}</div><div>Imprint</div>"
    rows = [(k, f"http://h.example/p/{k}", frame(f"text number {k}")) for k in range(5)] + [(9, "http://lone.example/x", frame("lone"))]
    got = {r["page_id"]: r["text"] for r in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"text number {k}" for k in range(5)} | {9: "Site name Menu of things lone Imprint"}


def brute_text(lines, neighbours):
    """Open lines in no longest common subsequence with the first neighbour that does not share them all go, by the plain table."""
    for near in neighbours:
        n, m = len(lines), len(near)
        t = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if lines[i] == near[j] else max(t[i + 1][j], t[i][j + 1])
        i = j = 0
        shared = set()
        while i < n and j < m:
            if lines[i] == near[j] and t[i][j] == t[i + 1][j + 1] + 1:
                shared.add(i)
                i, j = i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                i += 1
            else:
                j += 1
        if any(x[0] == "o" and k not in shared for k, x in enumerate(lines)):
            return " ".join(x[1:] for k, x in enumerate(lines) if x[0] == "m" or x[0] == "o" and k not in shared)
    return " ".join(x[1:] for x in lines if x[0] in "mo")


def test_the_neighbour_decides_on_open_lines():
    rng = random.Random(9)
    for _ in range(200):
        body = lambda: [rng.choice("om-") + f"own {rng.randrange(10**9)}" for _ in range(rng.randrange(6))]
        top, foot = ["oSite", "-menu", "oCrumbs"], ["oAbout", "-foot", "oImprint"]
        pages = [top + body() + foot for _ in range(3)]
        pages[2] = rng.choice([pages[0], pages[2]])
        for near in ([], [pages[1]], [pages[2], pages[1]]):
            text, n_shared, n_deleted = page_diff.main_text(pages[0], *near)
            assert text == brute_text(pages[0], near)
        alone, beside = page_diff.main_text(pages[0])[0], page_diff.main_text(pages[0], pages[1])[0]
        assert alone.startswith("Site") and (beside != alone) == any(x[:4] == "oown" for x in pages[0])


def test_body_outside_the_article(spark):
    page = lambda k: f"<div>Frame</div><article>Teaser {k % 2}</article><div>Body {k}</div><div>End</div>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(4)] + [(7, "http://h.example/3b", page(3))]
    got = {r["page_id"]: (r["text"], r["n_deleted"]) for r in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: got[k] for k in range(4)} == {k: (f"Teaser {k % 2} Body {k}", 2) for k in range(4)} and got[7][0] == "Frame Teaser 1 Body 3 End"


def test_blocks_do_not_matter(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    rng = random.Random(4)
    rows = [(k, f"http://h{k % 3}/{rng.choice('abc')}/{k % 11}", "".join(f"<p>{rng.choice(['menu', 'foot', 'line'])} {rng.randrange(3)}" for _ in range(8))) for k in range(120)]
    q = spark.createDataFrame(rows, "page_id long, url string, html string")
    for df in (p, q):
        one, many = ([tuple(r) for r in page_diff.extract(df, blocks=n).orderBy("page_id").collect()] for n in (1, 40))
        assert one == many and len(one) == df.count()
    by = sorted((f"h{k % 3}", u.split("/", 3)[3], k, h) for k, u, h in rows)
    want = {}
    for n, (host, path, k, h) in enumerate(by):
        mates = [by[m] for m in (n - 1, n + 1) if 0 <= m < len(by) and by[m][0] == host]
        mates.sort(key=lambda x: -page_diff._common("/" + x[1], "/" + path))
        want[k] = page_diff.main_text(page_diff.lines_of(h), *[page_diff.lines_of(x[3]) for x in mates])[0]
    assert {r[0]: r[2] for r in many} == want


def test_extract_cases(spark):
    rows = [(None, None, None), (1, "not a url", "<p>a"), (1, "not a url", "<p>a"), (2, "http://x", "")]
    got = page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))).collect()
    assert len(got) == 4 and {r["text"] for r in got if r["page_id"] != 1} == {""}
    assert page_diff.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
