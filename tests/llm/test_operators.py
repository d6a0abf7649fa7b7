"""The corpus operators against brute-force versions on small fixtures."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.llm import chat, decontaminate, hashing, hilbert, htmltext, jaccard, licences, packing, personal, quality, sentences
from costlens.llm.common import default_tokenizer

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeéghilmnoprst"), rng.integers(1, 9))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def edited(text: str, places: list[int]) -> str:
    words = text.split(" ")
    for p in places:
        words[p] = f"x{p}y"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts() -> dict[int, str | None]:
    a, b, c = prose(1, 160), prose(2, 60), prose(3, 900)
    out: dict[int, str | None] = {1: a, 2: a, 3: edited(a, [5]), 4: edited(a, [90, 140]), 5: edited(a, list(range(0, 160, 8)))}
    out |= {6: b, 7: b.upper(), 8: b + " tail", 9: None, 10: "", 11: " \n\t ", 12: "one two", 13: "ONE  two", 14: c, 15: edited(c, [700])}
    out |= {20 + i: edited(a, [i * 3, i * 3 + 50]) for i in range(12)}
    out |= {40: "lone", 41: c + " " + b, 42: prose(4, 30)}
    return out


def frame(spark, rows: dict[int, str | None]):
    """With columns whose names clash with the operators' own."""
    data = [(k, v, "en", f"src{k % 3}", len(v or ""), 1, "r") for k, v in rows.items()]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, rank int, row string")


def empty(spark):
    return frame(spark, {1: "x"}).limit(0)


def grams(text: str | None, k: int) -> frozenset:
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows: dict[int, str | None], k: int, percent: int) -> dict[int, int]:
    sets = {i: grams(t, k) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, texts, k, percent):
    rows = jaccard.components_of(frame(spark, texts), k, percent).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_components(texts, k, percent)
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(grams(t, k)) for i, t in texts.items()}


def test_jaccard_keeps_one(spark, texts):
    docs = frame(spark, texts)
    kept = jaccard.keep_one(docs.union(docs.filter("doc_id = 14")))
    root = brute_components(texts, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in texts if root[i] == i)
    assert kept.columns == docs.columns
    assert jaccard.keep_one(empty(spark)).count() == 0


def test_segment_marks_meet_for_linked_sets():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        for _ in range(300):
            n = int(rng.integers(2, 400))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop, add = int(rng.integers(0, n // 8 + 1)), int(rng.integers(0, n // 8 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and drop + add:
                assert np.intersect1d(jaccard.segment_marks(a, percent), jaccard.segment_marks(b, percent)).size


def test_hashing_reads_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(hashing, "BLOCK", 64)
    text = ("word other  Ünï " * 40 + "z" * 300 + " end").encode()
    h, s, e = hashing.word_hashes(np.frombuffer(text, dtype=np.uint8), hashing.BLANK_SEPARATED)
    words = [text[a:b] for a, b in zip(s, e)]
    assert words == text.split()
    assert len(set(zip(h.tolist(), words))) == len(set(words)) == len(set(h.tolist()))


def brute_hits(text, windows):
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, items = set(), set()
    for length in {len(x) for x in windows}:
        for i in range(len(w) - length + 1):
            if (found := windows.get(tuple(w[i : i + length]))) is not None:
                hit.update(range(i, i + length))
                items |= found
    return len(w), len(hit), items


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontamination(spark, block_bytes):
    item, short = prose(7, 30), "Kurz, nur drei"
    rows = {1: "pre " + item.upper() + " post", 2: prose(8, 40) + " kurz nur-drei " + prose(9, 300), 3: item[:40], 4: None, 5: "", 6: prose(10, 50), 7: " ".join(ALNUM.findall(item)[3:16]), 8: item + "\n" + item}
    bench = spark.createDataFrame([(1, item), (10, short), (2, item), (3, None), (4, "!!"), (None, "absent words")], "item_id long, text string")
    windows = defaultdict(set)
    for i, t in ((1, item), (10, short), (2, item)):
        w = ALNUM.findall(t.translate(LOWER))
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            windows[tuple(w[k : k + n])].add(i)
    docs = frame(spark, rows).union(frame(spark, {8: rows[8]}))
    found = decontaminate.hits(docs.select(F.struct("doc_id").alias("row"), "text"), bench, block_bytes=block_bytes)
    n_hit = decontaminate.covered(F.col("spans"))
    got = sorted((r.d, r.n_words, r.n, tuple(sorted(r["items"]))) for r in found.select(F.col("row.doc_id").alias("d"), "n_words", n_hit.alias("n"), "items").collect())
    want = sorted((i, n, h, tuple(sorted(map(str, items)))) for i in [*rows, 8] for n, h, items in [brute_hits(rows[i], windows)])
    assert got == want
    report = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    for i, t in rows.items():
        n, h, items = brute_hits(t, windows)
        assert report[i].contaminated == (h > 0 and 20 * h >= n)
        assert report[i].items_sha256 == hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
    kept = decontaminate.filter_documents(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in rows if not report[i].contaminated)
    assert kept.schema == docs.schema
    assert decontaminate.filter_documents(docs, bench.limit(0)).count() == docs.count()


def test_packing_places_every_piece(spark, texts):
    from tokenizers import Tokenizer

    rows = dict(texts) | {50: prose(11, 6000), 51: "a" * 5000, 52: "\x1c  é İ Σ x <|endoftext|>"}
    docs = frame(spark, rows).union(frame(spark, {50: rows[50]}))
    packed = packing.pack(docs, default_tokenizer(), with_ids=True).cache()
    t = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for i in [*rows, 50]:
        ids = t.encode(rows[i] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at : at + 2048]
            want[(i, k, at, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes()))] += 1
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    for s in packing.sequences(packed).collect():
        assert len(s.ids) == sum(p.length for p in s.pieces)
    assert packing.pack(empty(spark), default_tokenizer()).count() == 0


def test_packing_cuts_long_texts_at_blanks(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    encoder, t = packing.WordEncoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    rows = [prose(21, 700), "", None, "b" * 90 + " c.", prose(22, 40) + "\n" * 60, "x y"]
    want = [t.encode(r or "", add_special_tokens=False).ids + [0] for r in rows]

    def got():
        found = []
        for ids, ends in encoder.texts(pa.array(rows)):
            found += [x.tolist() for x in np.split(ids, ends[:-1])]
        return found

    assert got() == want
    monkeypatch.setattr(packing, "LONG", 50)
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 30)
    assert got() == want


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_is_near_the_least(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6, 1, 3000).astype(int), 1, 2048)
    counts = dict(Counter(lengths.tolist()))
    plan = packing.best_plan(counts)
    least = -(-int(lengths.sum()) // 2048)
    assert least <= plan.sequences <= least * 1.02 + 2
    ranks = defaultdict(list)
    for length, a, b, *_ in plan.places:
        ranks[length].append((a, b))
    for length, n in counts.items():
        assert [x for r in sorted(ranks[length]) for x in r][::2][0] == 0 and sorted(ranks[length])[-1][1] == n


PAGE = """<html><head><title>no</title><style>x{}</style></head><body><nav><a href=1>menu</a></nav>
<header class="site">Site</header><div class="content"><h1>A &amp; B</h1><p>First  paragraph of the article,
long enough.<p>Second &lt;one&gt; with <a href=x>a link</a> and &#233;.<div class="ad-box">buy</div><ul><li>x<li>y</ul></div>
<div id="comments"><p>reader</p></div><form>f</form><footer>foot</footer><script>var a="</p>"</script></body></html>"""


def test_html_extraction(spark):
    cases = {1: PAGE, 2: None, 3: "", 4: "<script>x", 5: "plain < text &amp", 6: "<article><h1>T</h1><p><b>a<br><p>b</article><footer>c</footer>", 7: "<div>" * 5000 + "deep" + "</div>" * 5000}
    want = {1: "A & B\nFirst paragraph of the article, long enough.\nSecond <one> with a link and é.\nx\ny", 2: "", 3: "", 4: "", 5: "plain < text &", 6: "T\na\nb", 7: "deep"}
    pages = spark.createDataFrame([(k, "u", v, 1) for k, v in cases.items()], "page_id long, url string, html string, n_chars int")
    rows = htmltext.main_text(pages).collect()
    assert {r.page_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)
    assert htmltext.main_text(pages.limit(0)).count() == 0


def test_html_keeps_all_picks_in_page_order():
    para = lambda w, n=40: "<p>" + f"{w} text of the page " * n + "</p>"
    nav = "<nav><a href=1>menu</a></nav>"
    two = f"<body>{nav}<article>{para('one') * 3}</article><article>{para('two') * 3}</article></body>"
    text = htmltext.extract(two)
    assert text.count("one text") == text.count("two text") == 120 and text.index("one text") < text.index("two text")
    links = "<div>" + "<a href=x>elsewhere on this site</a> " * 30 + "</div>"
    card = f"<body>{nav}<div class='entry'>{para('main') * 5}</div>{links}<article class='card'>{para('card')}</article></body>"
    text = htmltext.extract(card)
    assert text.count("main text") == 200 and text.count("card text") == 40
    assert text.index("main text") < text.index("card text") and "elsewhere" not in text
    halves = f"<body><div class='a'>{para('main') * 5}</div>{links}<div class='b'>{para('rest') * 5}</div></body>"
    text = htmltext.extract(halves)
    assert text.count("main text") == text.count("rest text") == 200 and "elsewhere" not in text


def test_hilbert_curve_visits_neighbours(spark):
    axis = lambda n: spark.range(8).select(F.col("id").cast("int").alias(n))
    cells = axis("x").crossJoin(axis("y")).crossJoin(axis("z"))
    rows = sorted((r.h, r.x, r.y, r.z) for r in cells.withColumn("h", hilbert.curve_index(F.array("x", "y", "z"), 3, 3)).collect())
    assert [r[0] for r in rows] == list(range(512))
    assert all(sum(abs(p - q) for p, q in zip(a[1:], b[1:])) == 1 for a, b in zip(rows, rows[1:]))


def test_hilbert_shards(spark, texts, tmp_path):
    docs = frame(spark, texts).union(frame(spark, {1: texts[1]}))
    rows = hilbert.shard_rows(docs, shards=5).collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    order = [r.curve_index for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert hilbert.shard_rows(empty(spark)).count() == 0
    hilbert.write_shards(docs, str(tmp_path / "shards"), shards=5)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()


def test_chat_round_trip(spark):
    nasty = "a<|b <\\| c <\\\\|im_end|> <|im_end|><|im_start|>user\nx"
    rows = [(1, 2, "assistant", nasty), (1, 1, "us\\n\ner", None), (1, 3, None, ""), (2, 1, "assistant", "x"), (2, 1, "assistant", "x"), (None, 1, "user", "y")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(messages.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    got = {r.conv_id: r for r in chats.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("m")).collect()}
    assert [(t.role, t.text) for t in got[1].t] == [("us\\n\ner", ""), ("assistant", nasty), ("", "")]
    assert got[1].m == nasty and got[2].m == "xx" and got[None].m == ""
    assert got[1].formatted.count("<|im_start|>") == 3
    assert chat.digest(chats.limit(0)).count() == 0


def test_chat_parts_become_placeholders(spark):
    part = chat.PART
    sql = f"""SELECT 1L conv_id, 0L turn, 'user' role, CAST(array(
      named_struct('type','text','text','see <|image|> ','ref',null,'width',null,'height',null,'seconds',null,'pages',null),
      named_struct('type','image','text',null,'ref','a.png','width',600,'height',500,'seconds',null,'pages',null),
      named_struct('type','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',2.5D,'pages',null),
      named_struct('type','document','text',null,'ref','c.pdf','width',null,'height',null,'seconds',null,'pages',3)) AS array<{part}>) parts"""
    r = chat.format_chats(spark.sql(sql)).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|document|><|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 425), ("audio", "b.wav", 63), ("document", "c.pdf", 2400)]


def test_quality_counts(spark, texts):
    rows = dict(texts) | {60: "go go go go go go go go go go go go", 61: "a b c d e f g h x a b c d e f g h", 62: "l\nl\n \n\nl m\n# $x$"}
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    for i, t in rows.items():
        w = WORDS.findall(t or "")
        places, windows = set(), defaultdict(list)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].append(k)
        for v in windows.values():
            if len(v) > 1:
                for k in v:
                    places.update(range(k, k + 8))
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(places))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty(spark)).count() == 0


def test_quality_finds_the_labelled_classes(spark):
    """The model sees no labels; it is held against all of them."""
    sf = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows)
    assert right >= 0.97 * len(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in judged.filter("kept").collect()}
    assert {r.doc_id for r in quality.filter_documents(docs).select("doc_id").collect()} == kept


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def base_of(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


PII = [
    "mail é a.b@c.de_f@g.hh.i and x@y z@w.v.", "1.2.3.4.5.6.7.8 999.1.1.1.1 0001.02.3.255 1.2.3", "4111 1111-1111 1111 12 4111111111111112 5 5",
    "+1 (017) 555-7713. +1+49 30 1234567-", "a@b.c@d.e 💥 q@r.st 10.0.0.1@x.y", "", "a" * 30000 + "@", "1" * 20000, "1 " * 5000, "+" * 3000 + "1", "a.b" * 4000 + "@x" + ".y" * 3000,
]


def test_personal_base_spans(spark):
    docs = frame(spark, {i: t for i, t in enumerate(PII)} | {99: None})
    got = {r.doc_id: r for r in personal.find(docs).collect()}
    for i, t in [*enumerate(PII), (99, "")]:
        spans = base_of(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = Counter(k for k, _, _ in spans)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in BASE)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    assert personal.find(empty(spark)).count() == 0


def test_personal_patterns_discover(spark):
    """Contexts that only seeds fill bring in an identifier of another form."""
    rows = {i: f"{prose(i, 20)} contact via mail: user{i}@host{i}.example.org now {prose(100 + i, 20)}" for i in range(8)}
    rows[50] = f"{prose(50, 20)} contact via mail: user77[at]host77-example now {prose(51, 9)}"
    rows[51] = f"{prose(52, 20)} order number 1234567 shipped"
    got = {r.doc_id: r.spans for r in personal.find(frame(spark, rows)).collect()}
    assert got[50].startswith("email:") and got[51] == ""
    at = rows[50].index("user77")
    assert got[50] == f"email:{at}:{at + len('user77[at]host77-example')}"
    assert all(got[i].count("email:") == 1 for i in range(8))


def test_personal_discovery_goes_on_from_what_it_found(spark):
    """An identifier whose context meets discovered identifiers only, and one
    behind that."""
    one = lambda i, x: f"{prose(300 + i, 9)} contact via mail: {x} now {prose(400 + i, 9)}"
    two = lambda i, x: f"{prose(500 + i, 9)} under handle {x} please {prose(600 + i, 9)}"
    three = lambda i, x: f"{prose(700 + i, 9)} known as {x} here {prose(800 + i, 9)}"
    name = lambda i: f"user{1000 + i}[at]host"
    rows = {i: one(i, f"user{i}@host{i}.example.org") for i in range(60)}
    rows |= {100 + i: one(60 + i, name(i)) for i in range(10)}
    rows |= {200 + i: two(i, name(i)) for i in range(11)}  # name 10 is met here first
    rows |= {300 + i: three(i, name(i)) for i in range(4, 12)}  # name 11 only here
    rows[400] = f"{prose(900, 9)} order number 1234567 shipped"
    got = {r.doc_id: r.spans for r in personal.find(frame(spark, rows)).collect()}
    for i, t in rows.items():
        want = "" if i == 400 else f"email:{t.index('user')}:{t.index(' ', t.index('user'))}"
        assert got[i] == want


def test_personal_redaction(spark):
    docs = frame(spark, {1: "é a@b.cc, 10.0.0.1@x.y!", 2: None, 3: "plain"})
    out = personal.redact(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "é [EMAIL], [EMAIL]!" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None or rows[2].text == ""
    assert rows[3].text == "plain" and out.columns == docs.columns


def test_licence_scan(spark):
    rows = {
        1: prose(1, 50) + "\nReleased under the MIT License.\n" + prose(2, 50),
        2: prose(3, 80) + " this work is licensed under the gnu general public license, VERSION 3 " + prose(4, 9),
        3: prose(5, 300), 4: None, 5: "", 6: licences.TEMPLATES["MIT"][1], 7: "the license of the work",
    }
    got = {r.doc_id: r for r in licences.scan(frame(spark, rows)).collect()}
    assert {i: got[i].licence for i in rows} == {1: "MIT", 2: "GPL-3.0", 3: None, 4: None, 5: None, 6: "MIT", 7: None}
    assert got[6].dice == 1.0 and got[1].licences[0].start_word == 50
    assert licences.scan(empty(spark)).count() == 0


def test_licence_scan_finds_every_passage_brute_force_finds():
    templates = [licences.Template(n, t) for n in sorted(licences.TEMPLATES) for t in licences.TEMPLATES[n]]
    known = np.ones(1 << 16, dtype=bool)
    text = prose(1, 20) + " Licensed under CC BY NC 4.0 " + prose(2, 20) + " released under the mit licence " + prose(3, 5)
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    order, _ = licences.bigrams(data)
    best = {}
    for t in templates:
        for s in range(len(order)):
            unit = set(order[s : s + t.length].tolist())
            dice = 2 * len(unit & set(t.grams.tolist())) / (len(unit) + len(t.grams))
            if dice >= 0.85:
                best[t.name] = max(best.get(t.name, 0), dice)
    found = {x["licence"]: x["dice"] for x in licences.licences_of(data, templates, known, 0.85)[1]}
    assert found and all(best[n] == pytest.approx(d) for n, d in found.items())
    assert max(best, key=best.get) in found


GNU_NOTICE = """{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by
the Free Software Foundation{1} either version {3} of the License, or (at your option) any later version. {0} is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
{2} for more details."""


def test_licence_neighbours_and_whole_texts():
    templates = [licences.Template(n, t) for n in sorted(licences.TEMPLATES) for t in licences.TEMPLATES[n]]
    known = np.ones(1 << 16, dtype=bool)
    of = lambda text: [x["licence"] for x in licences.licences_of(np.frombuffer(text.encode(), dtype=np.uint8), templates, known, 0.85)[1]]
    lesser, affero = "Lesser General Public License", "Affero General Public License"
    notices = {
        "GPL-2.0": ("This program", ";", "General Public License", "2"), "GPL-3.0": ("This program", ",", "General Public License", "3"),
        "AGPL-3.0": ("This program", ",", affero, "3"), "LGPL-2.1": ("This library", ";", lesser, "2.1"), "LGPL-3.0": ("This library", ",", lesser, "3"),
    }
    for name, parts in notices.items():
        notice = GNU_NOTICE.format(*parts)
        for text in (notice, notice.split(" any later version.")[0] + " any later version."):
            assert of(prose(1, 40) + " " + text + " " + prose(2, 40)) == [name]
    for kind, name in (("Attribution", "BY"), ("Attribution-NoDerivatives", "BY-ND"), ("Attribution-NonCommercial-ShareAlike", "BY-NC-SA")):
        assert of(f"{prose(1, 9)} This work is licensed under a Creative Commons {kind} 4.0 International License. {prose(2, 9)}") == [f"CC-{name}-4.0"]
    for name in licences.TEXTS:
        whole = licences.TEXTS[name]
        assert of(whole) == [name]
        assert of(prose(3, 60) + " Copyright 2020 A. B. " + whole.replace("\n", " ") + prose(4, 60)) == [name]
    assert {"AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= set(licences.TEXTS)


def test_sentence_spans(spark, texts):
    shared = prose(77, 60)
    rows = dict(texts) | {70: prose(78, 40) + ".\n" + shared + " " + prose(79, 30), 71: shared + "\n" + prose(80, 30) + ".\n" + shared, 72: prose(81, 70)}
    docs = frame(spark, rows).union(frame(spark, {72: rows[72]}))
    got = sorted(((r.doc_id, r.n_removed, r.text) for r in sentences.remove_repeats(docs).collect()), key=str)
    seen, want = set(), []
    for i in sorted(rows):
        t = rows[i]
        if not t:
            want.append((i, 0, t))
            continue
        bounds = sentences.sentences_of(t)
        parts = [t[a:b].lower().split() for a, b in bounds]
        gone = set()
        for first, after in sorted(sentences.runs_of([len(p) for p in parts], 2, 16)):
            key = "\n".join(" ".join(p) for p in parts[first:after])
            if key in seen:
                gone.update(range(first, after))
            seen.add(key)
        want.append((i, len(gone), "".join(t[a:b] for k, (a, b) in enumerate(bounds) if k not in gone)))
    want.append(want[-1])  # rows that repeat doc_id and text get the same result
    assert got == sorted(want, key=str)
    assert sentences.remove_repeats(empty(spark)).count() == 0


def test_repeats_without_sentence_ends_go(spark):
    """Passages of 50 words without a whole sentence, at any place in a text
    without marks or inside one long sentence."""
    words = lambda seed, n: prose(seed, n).replace(".", "")
    for seed in range(200):
        passage = words(1000 + seed, 50)
        texts_ = (f"{words(2000 + seed, 20 + seed % 9)} {passage} {words(3000 + seed, 30)}", f"{words(4000 + seed, seed % 13)} {passage.upper()} {words(5000 + seed, 20)}".strip())
        runs = []
        for t in texts_:
            parts = [t[a:b].lower().split() for a, b in sentences.sentences_of(t)]
            assert "".join(t[a:b] for a, b in sentences.sentences_of(t)) == t
            runs.append({tuple(map(tuple, parts[a:b])) for a, b in sentences.runs_of([len(p) for p in parts], 2, 16)})
        assert runs[0] & runs[1]
    row = words(1, 60)
    docs = frame(spark, {1: row, 2: row, 3: f"{prose(2, 40)}. {words(3, 30)} {row} {words(4, 30)}", 4: words(5, 60)})
    got = {r.doc_id: r for r in sentences.remove_repeats(docs).collect()}
    assert got[1].text == row and got[2].text == "" and got[4].n_removed == 0
    assert got[3].n_removed > 0 and len(got[3].text.split()) <= 40 + 30 + 30 + 26
