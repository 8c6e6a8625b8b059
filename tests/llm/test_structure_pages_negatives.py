"""Structure repair, HTML extraction and hard negatives, each against a brute-force version on small tables with odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sleuthframe.llm import hard_negatives, html_extraction, structure_repair

# Structure repair. The brute force goes backward over rows and states and keeps whole strings.

AFTER = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NEW = ["user", "user", "assistant", "user"]


def after_damage(rows):
    def shown(x):
        return " " if x is None else str(x)

    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for of_conv in groups.values():
        of_conv.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    return groups


def cheapest(rows, faults):
    best = {(len(rows), 0): (0, "", ()), (len(rows), 3): (0, "", ())}

    def offer(node, to, cost, letter, lines):
        if to in best:
            c, audit, rest = best[to]
            found = (c + cost, letter + audit, lines + rest)
            if node not in best or found[:2] < best[node][:2]:
                best[node] = found

    for i in range(len(rows), -1, -1):
        for q in range(4):
            if i < len(rows):
                _, role, text = rows[i]
                more = 3 * (faults[i] == "truncated")
                offer((i, q), (i + 1, q), 4, "D", ())
                if faults[i] not in ("blank", "duplicate"):
                    if role[:1] in AFTER[q]:
                        offer((i, q), (i + 1, AFTER[q][role[:1]]), more, "K", (f"{role}:{text}",))
                    offer((i, q), (i + 1, AFTER[q][NEW[q][0]]), 3 + more, "R", (f"{NEW[q]}:{text}",))
        for _ in range(3):
            for q in range(4):
                offer((i, q), (i, AFTER[q][NEW[q][0]]), 3, "I", (f"{NEW[q]}:",))
    return best[0, 0]


def repaired(rows):
    for conv, own in after_damage(rows).items():
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(own, faults)
        yield (conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    pick = random.Random(5)
    rows = [(900, 1, "user", "Only."), (900, 1, "user", "Only."), (None, 1, "user", "No id."), (None, 2, "assistant", "None."), (901, None, None, None), (902, 5, "", "Odd role."), (902, -7, "Ωmega", "é!")]
    for conv in range(60):
        for turn in range(pick.randint(1, 12)):
            role = pick.choice(["system", "user", "user", "assistant", "assistant", "tool", None])
            text = pick.choice(["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "Long one. " * 50, f"Turn {turn}.", "ends in nbsp. "])
            rows.append((conv, pick.choice([turn, turn, turn * 2, None]), role, text))
    rows += [(77, t, ("user", "assistant")[t % 2], f"Word {t}." if t % 7 else "again") for t in range(200)]
    return rows


@pytest.mark.parametrize("block", [1024, 3, 1])
def test_repair_agrees_with_brute_force(spark, block):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, cost string, part string").repartition(3)
    got = sorted((tuple(r) for r in structure_repair.repair(table, block).collect()), key=repr)
    assert got == sorted(repaired(rows), key=repr)


def test_repair_of_other_keys_long_texts_and_nothing(spark):
    rows = [("a", 1, "user", "x" * 300_000 + "."), ("a", 2, "assistant", "y" * 300_000), ("b", 1, "system", "S.")]
    table = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    assert sorted(tuple(r) for r in structure_repair.repair(table, chars=1_000).collect()) == sorted(repaired(rows))
    assert structure_repair.repair(table.limit(0)).collect() == []


def test_repair_of_one_row_repeated_by_the_thousand(spark):
    table = spark.range(5_000).selectExpr("8L conv_id", "1L turn", "'user' role", "'Hello.' text")
    (row,) = structure_repair.repair(table).collect()
    (want,) = repaired([(8, 1, "user", "Hello.")] * 5_000)
    assert tuple(row) == want and row.duplicate >= 4_999


# HTML extraction.

WORDS = "harbour lantern meadow quarrel thimble orchard gravel saddle pepper window marble copper".split()


def sentence(seed, n=30):
    pick = random.Random(repr(seed))
    return " ".join(pick.choice(WORDS) for _ in range(n)).capitalize() + "."


def blog(i):
    body = [sentence((i, k)) for k in range(1 + i % 4)]
    extra = '<div class="cookie-notice">We use cookies.</div>' if i % 3 else ""
    page = f"""<html><head><title>t</title><style>p{{}}</style><script>if (a<b) "</p>"</script></head><body>{extra}<header><a href=/>Home</a></header>
      <nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><!-- <p>not here</p> --><article class="post post-{i}"><h2>Title {i} &amp; more</h2>
      {"".join(f"<p>{p[:40]}<b>{p[40:]}</b>" for p in body)}<form><input><label>Mail</label></form></article>
      <aside><p>{sentence(("side", i), 60)}</p></aside><section id="comments"><article class="comment"><p>{sentence(("c", i), 80)}</p></article></section><footer>&copy; me</footer>"""
    return page, "\n\n".join([f"Title {i} & more", *body])


def bare(i):
    """No block is marked: the text is where most characters are; one line is the same on all pages."""
    body = [sentence((i, "n", k), 40) for k in range(2 + i % 3)]
    page = f'<div class="x1"><a href=/>Start</a> <a href=/k>Kontakt</a></div><div class="x2">{"".join(f"<div>{p}</div>" for p in body)}<p>Read more on our site.</p></div><div class="ad-slot">{sentence(i, 200)}</div>'
    return page, "\n\n".join(body)


def sections(i):
    blocks = list(itertools.chain(*((("h3", f"Part {k}"), ("p", sentence((i, k, "p"))), ("ul", [sentence((i, k, j, "li"), 5) for j in range(2)])) for k in range(1 + i % 5))))
    page = "<body><main>" + "".join(f"<ul>{''.join(f'<li>{x}' for x in text)}</ul>" if tag == "ul" else f"<{tag}>{text}</{tag}>" for tag, text in blocks) + '</main><div class="related"><p>See also</p></div>'
    return page, "\n\n".join(itertools.chain(*(text if tag == "ul" else [text] for tag, text in blocks)))


def pages():
    rows = []
    for i in range(40):
        for host, make in (("blog.example.com", blog), ("Bare.example.org:80", bare), ("user@sections.example.net", sections)):
            html, text = make(i)
            rows.append((len(rows), f"https://{host}/p{i}?q", html, text))
    odd = [
        (None, ""), ("", ""), ("plain & simple\n text", "plain & simple text"), ("<p>a<br>b&nbsp;&#x41;&lt;p&gt;", "a b A<p>"), ("<script>never ends", ""), ("<!-- never ends", ""),
        ("<div>" * 500 + "deep" + "</div>" * 500, "deep"), ("<nav><p>menu</p></nav>", ""), ("a < b and c > d <", "a < b and c > d <"), ("<p title=\"x > y\" class='ad'>no</p><p title=\"open>yes", "yes"),
        ("<article>" + "".join(f"<p>{i}</p><h2>{i}</h2>" * (1 + i % 3) + "<table><tr><td>c<td>d</table>" for i in range(400)), None),
        ("x" * 300_000, "x" * 300_000),
    ]
    rows += [(1_000 + i, f"http://odd{i}.example.com/", html, text) for i, (html, text) in enumerate(odd)]
    return rows + [(2_000, None, "<p>no url</p>", "no url"), (2_001, "not a url", "<p>no host</p>", "no host"), (3, rows[3][1], rows[3][2], rows[3][3])]


def test_main_text_of_many_layouts(spark):
    rows = pages()
    table = spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h, _ in rows], "page_id long, url string, html string, host string, wrapper string").repartition(60)
    got = sorted((tuple(r) for r in html_extraction.main_text(table).collect()), key=repr)
    assert len(got) == len(rows)
    want = {i: t for i, _, _, t in rows}
    for i, _, text, n in got:
        assert n == len(text)
        if want[i] is None:
            assert text.count("\n\n") == sum(2 * (1 + k % 3) + 2 for k in range(400)) - 1
        else:
            assert text == want[i]
    assert html_extraction.main_text(table.limit(0)).collect() == []


def test_light_hosts_meet_their_wrappers_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(html_extraction, "HEAVY", 2)
    rows = pages()[:60]
    table = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.main_text(table).collect()} == {i: t for i, _, _, t in rows}


def test_wrappers_are_union_free_expressions():
    def shape(*htmls):
        items = html_extraction.wrapper_of(html_extraction.page_tree(htmls[0]))
        for h in htmls[1:]:
            items = html_extraction.aligned(items, html_extraction.wrapper_of(html_extraction.page_tree(h)))

        def written(xs):
            return " ".join((f"({written(x[7])})" if x[0] == "()" else x[0] + (f"[{written(x[7])}]" if x[7] else "")) + ("?" if x[1] else "") + ("+" if x[2] else "") for x in xs)

        return written(items)

    assert shape("<h1>a</h1><p>b</p><p>c</p>") == "h1[#] p[#]+"
    assert shape("<h1>a</h1><p>b</p>", "<p>b</p><div>x</div>") == "h1[#]? p[#] div[#]?"
    assert shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl>") == "dl[(dt[#] dd[#])+]"


# Hard negatives.


def mined(rows):
    whole = {}
    for vec, v, label in rows:
        if vec is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if vec % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v])
        whole[vec] = min(whole.get(vec, row), row)
    out = []
    for a, (label, v) in whole.items():
        if a % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), o, l) for o, (l, w) in whole.items() if o != a and len(w) == len(v))
            for p, positive, _ in [s for s in scored if s[2] == label][:5]:
                chosen = [(s, o) for s, o, l in scored if l != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
                out += [(a, positive, i + 1, o, -p, -s) for i, (s, o) in enumerate(chosen)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i * 10), [float(x) for x in (centres[i % 6] + rng.normal(size=8) * 0.6).astype("f4")], int(i % 4)) for i in range(700)]
    rows += [(20_000 + i, rows[3][1], 2) for i in range(150)] + [rows[0], (100, [9.0] * 8, 9), (300, [0.0] * 8, 1)]
    rows += [(30_000 + 50 * i, [1.0, 0.5 * i], i % 2) for i in range(20)]
    rows += [(None, [1.0] * 8, 1), (40_000, None, 1), (40_100, [1.0] * 8, None), (40_200, [1.0] * 7 + [None], 1), (40_300, [float("nan")] * 8, 1), (40_400, [float("inf")] * 8, 1), (40_500, [], 1)]
    return rows


@pytest.mark.parametrize("chunk, team", [(4_096, 1_024), (40, 2)])
def test_negatives_agree_with_brute_force(spark, chunk, team):
    table = spark.createDataFrame([(*r, "x") for r in vectors()], "vec_id long, embedding array<float>, label int, rank string")
    assert sorted(tuple(r) for r in hard_negatives.mine(table, chunk, team).collect()) == mined(vectors())


def test_negatives_of_a_sample_smaller_than_the_table(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SAMPLE", 60)
    table = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in hard_negatives.mine(table, 64, 3).collect()) == mined(vectors())


def test_negatives_beyond_double_precision_and_of_nothing(spark):
    rows = [(i, [float(2**20 + i), float(3 * i)], i % 2) for i in range(0, 400, 20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in hard_negatives.mine(table).collect()) == mined(rows)
    assert hard_negatives.mine(table.limit(0)).collect() == []


def test_bounds_keep_rows_from_teams_they_cannot_serve(spark):
    rng = np.random.default_rng(1)
    # far clusters of one length: a team needs its own only
    rows = [(i, [float(x) for x in np.eye(8)[i % 8] * 4 + rng.normal(size=8) * 0.01], i % 2) for i in range(4_000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    index = hard_negatives.Index(hard_negatives.prepared(table), 8, 512, 4)
    shared = spark.sparkContext.broadcast(index)
    placed = hard_negatives.prepared(table).mapInArrow(lambda b: hard_negatives.assign(b, shared), "vec_id long, label long, v array<double>, cell int, far double").cache()
    index.learn(placed)
    again = spark.sparkContext.broadcast(index)
    anchors = placed.where(hard_negatives.is_anchor()).selectExpr("*", "0L part", "cast(null as array<long>) ids", "cast(null as array<long>) scores").drop("far")
    teams = anchors.withColumn("team", anchors["cell"].cast("long")).groupBy("part", "team").applyInArrow(lambda t: hard_negatives.form_team(t, again, hard_negatives.wanted_positives), hard_negatives.ddl(hard_negatives.TEAMS))
    served = teams.where("cell is not null").groupBy("team").count().collect()
    assert served and max(r["count"] for r in served) < len(index.pivots)
