"""Training-text operators against brute force, round trips, held-out labels and odd input."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsieve.llm import canonical, encoding, language, leakage, neardup, newtext, packing, personal, truncated
from postsieve.session import table

AT = dt.datetime(2024, 1, 1)
MAIL = "id long, subject string, message string, lang string, mailbox string, loaded_at timestamp, text string, values string, print string, rep long, key string"


def mail(spark, rows):
    """rows (id, subject, message[, lang]); the other columns bear names that operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2], r[3] if len(r) > 3 else "en", "box-a", AT, "clash", "clash", "clash", 7, "clash") for r in rows], MAIL)


LONG = "The quick brown fox jumps over the lazy dog near the river bank. " * 6000
ODD = [(1, None, None), (2, "", ""), (3, " ", "  \n "), (4, "x", LONG), (5, "x", LONG), (5, "x", LONG), (None, "a", "b"), (6, "\x00", "é�")]


# 1 encoding
@pytest.mark.parametrize("text", ["Café für 30 €", "déjà vu – naïve", "Договор с заказчиком", "“quoted” text isn’t ours"])
@pytest.mark.parametrize("read", ["cp1252", "mac_roman", "cp437", "cp1251"])
def test_utf8_round_trip(text, read):
    try:
        bad = text.encode().decode(read)
    except UnicodeDecodeError:
        pytest.skip("bytes undefined there")
    if bad == text:
        pytest.skip("nothing garbled")
    assert encoding.repair(bad) == (text, True)


def test_encoding_layers_and_pairs():
    twice = "isn’t café".encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.repair(twice) == ("isn’t café", True)
    assert encoding.repair("Договор".encode("koi8_r").decode("cp1251")) == ("Договор", True)
    assert encoding.repair("Договор".encode("cp866").decode("cp1251")) == ("Договор", True)
    assert encoding.repair("résumé isn’t".encode("cp1252").decode("cp850")) == ("résumé isn’t", True)
    assert encoding.repair("Attività nuova".encode("mac_roman").decode("cp1252")) == ("Attività nuova", True) or encoding.repair("Attivit‡")[1]
    assert encoding.repair("see the note ‡ below") == ("see the note ‡ below", False)
    for clean in ("naïve Zoë à Paris", "Отчёт об ЭКСПОРТЕ", "São Paulo, AÇÃO", "Größe: 5 °C – „gut“", None, "", "plain"):
        assert encoding.repair(clean) == (clean, False)


WORLD = ["Zażółć gęślą jaźń w Poznaniu", "Škoda auto, příliš žluťoučký kůň", "Güneş ışığı ve çağrı", "και το νερό είναι καλό", "日本語の文章です", "中文测试", "Київ і Львів", "שלום עולם", "مرحبا بالعالم", "Őrült tűzoltó", "Tiếng Việt", "안녕하세요"]


@pytest.mark.parametrize("text", WORLD)
def test_other_languages(text):
    """Sound text of any language stays; read in the wrong encoding as a whole it comes back."""
    assert encoding.repair(text) == (text, False) and canonical.canonical(text) == text
    windows = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())
    assert encoding.repair(windows) == (text, True)
    assert encoding.repair(text.encode().decode("cp437")) == (text, True)
    assert encoding.repair(text.encode().decode("latin-1")) == (text, True)


def test_sound_punctuation_is_no_sequence():
    for clean in ("Der Gruß“ und Ä“ sagte", "café—“yes” and touché", "„Fuß“, „Straß“", "FÄ“ – À… É» – Ü”", "d’étape, l’équipe"):
        assert encoding.repair(clean) == (clean, False)


# 2 canonical forms
def test_canonical():
    c = canonical.canonical
    assert c("ｄｒａｆｔ　１２") == "draft 12" and c("café") == "café" and c("so​ft­ly﻿") == "softly" and c("a b") == "a b"
    assert c("Hоllis") == "Hollis" and c("Сіао") == "Ciao" and c("𝐝𝐫𝐚𝐟𝐭") == "draft"
    for same in ("“x” – … 1º 20 °C", "👨‍👩‍👧 🏳️‍🌈", "Договор с Torfo", "вас и нас", None, ""):
        assert c(same) == same
    for t in ("ｄｒ́а", "Ｃafé ‍", "́́x"):
        assert c(c(t)) == c(t)


# 3 personal details
def test_personal_patterns():
    m = personal.NameModel(np.zeros(personal.BUCKETS) - 1)
    kinds = lambda t: {k for _, _, k in personal.label([t], m)[0]}
    assert kinds("write to a.b+1@x.example or c at d dot test") == {"email"}
    assert kinds("call +44 20 7946 0162 or (312) 555-0150") == {"phone"}
    assert kinds("call three one two, 555 0123") == {"phone"}
    assert kinds("his SSN is 915-94-1584") == {"id_number"} and kinds("the tax id 961579212") == {"id_number"}
    assert kinds("we live at 124 Quill Street, Mossengate 05266") == {"street_address"} and kinds("Tarnstraße 78, 14177 Ort") == {"street_address"}
    assert kinds("order 1736870210 of 3 items, 10.76.26.88, release 4.2.256") == set()
    text = "mail a@b.example now"
    assert personal.replace(text, personal.label([text], m)[0]) == "mail [EMAIL] now"


@pytest.mark.parametrize("mark", ["(at)", "(AT)", "(a)", "[at]", "[AT]", "[a]", "[@]", "(@)", "<at>", "{at}"])
@pytest.mark.parametrize("dot", ["(dot)", "[dot]"])
def test_addresses_hidden_with_blanks(mark, dot):
    m = personal.NameModel(np.zeros(personal.BUCKETS) - 1)
    for before in ("", "ask ", "To:\n", "a(at)b.example,"):
        text = f"{before}oskar15 {mark} mail {dot} kaloren {dot} example, not us."
        got = personal.label([text], m)[0]
        assert (len(before), text.index("," if "," not in before else ", not"), "email") in got
        assert personal.replace(text, got).endswith("[EMAIL], not us.")


def test_marks_of_lists_hide_no_address():
    m = personal.NameModel(np.zeros(personal.BUCKETS) - 1)
    assert personal.label(["Under clause (a) above. The rest, item [a] below. And so on."], m)[0] == []


def test_message_passing_is_exact_on_a_chain():
    u, s, d, j = np.array([2.0, -0.5, -1.0]), np.array([0, 1]), np.array([1, 2]), np.array([0.9, 1.6])
    got = personal.propagate(u, s, d, j)
    states = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    weight = lambda x: np.exp(sum(u[i] * x[i] for i in range(3)) + sum(k for k, a, b in zip(j, s, d) if x[a] == x[b]))
    for i in range(3):
        on, off = sum(weight(x) for x in states if x[i]), sum(weight(x) for x in states if not x[i])
        assert got[i] == pytest.approx(np.log(on / off), abs=1e-6)


def test_the_field_decides():
    """A number with nothing near it to tell goes by its other mention, a weak name by its neighbours and mentions; alone they don't."""
    m = personal.NameModel(np.zeros(personal.BUCKETS) - 1)
    text = "His passport number is 961579212. " + "All of this was said before in some other place. " * 2 + "We noted 961579212 on Monday and 961579213 on Tuesday."
    on, off = (personal.label([text], m, field=f)[0] for f in (True, False))
    assert [text[s:e] for s, e, _ in on] == ["961579212", "961579212"] and [text[s:e] for s, e, _ in off] == ["961579212"]
    weights = np.zeros(personal.BUCKETS)
    for w, x in (("w=brandt", 20.0), ("w=ysolde", -0.8)):
        weights[personal._bucket(w)] = x
    m = personal.NameModel(weights, chain=0.9, skip=1.6)
    on, off = (personal.label(["we met Ysolde Brandt"], m, field=f)[0] for f in (True, False))
    assert len(on) == 2 and len(off) == 1


def test_edges_are_fitted():
    names = {"brandt", "ysolde", "petra", "holm"}
    texts = [f"Dear {a} {b}, the Report of {c} is due. {a} agreed." for a in ("Ysolde", "Petra") for b in ("Brandt", "Holm") for c in ("Monday", "Friday", "March")] * 4
    m = personal.fit_names(texts, names)
    assert 0.05 <= m.chain <= personal.MOST and 0.05 <= m.skip <= personal.MOST and m.least < -2 * m.chain - 2 * m.skip + 1e-9
    assert [texts[0][s:e] for s, e, _ in personal.label([texts[0]], m)[0]] == ["Ysolde", "Brandt", "Ysolde"]


def test_personal_names(spark, data):
    m, r = table(spark, data, "enron_dataset"), table(spark, data, "arf_result")
    found = personal.found(m, r)
    assert found.columns == ["tab", "rec_id", "kind"] and found.count() == found.distinct().count() > 50
    senders = {x["report_id"]: x["originalmailfrom"] for x in r.collect()}
    display = {i for i, v in senders.items() if v and re.match(r"^\w[\w-]+ \w[\w-]+ <", v)}
    named = {x["rec_id"] for x in found.where("tab = 'arf_result' and kind = 'person_name'").collect()}
    assert display <= named


# 4 newly written text
BODY = "Hello,\n\nmy answer.\n\nKind regards\nYsolde Brandt\nTel: +1 919 555 0146\n\nOn 2/27/2024, \"Brand, Petra\"\n<p@x.invalid> wrote:\n> old text\n> more\n\nand more of mine.\n\nThis message and its attachments are confidential and intended only for the recipient. If received in error, delete it."


def test_newly_written():
    assert newtext.parts_of(BODY) == ["quoted", "signature", "disclaimer"]
    assert newtext.newly_written(BODY) == "Hello,\n\nmy answer.\n\nand more of mine."
    assert newtext.parts_of("Thanks in advance.\n\nTalk soon.") == [] and newtext.parts_of("| A | 2 |\n-- item one\nFrom: depot 1. To: depot 2.") == []
    assert newtext.parts_of("Hi\n\n-----Original Message-----\nFrom: a\nSent: b\nTo: c\nSubject: d\n\nold") == ["quoted"]
    assert newtext.parts_of("ok\nSent from my phone") == ["signature"] and newtext.parts_of(None) == [] and newtext.newly_written("") == ""


def test_notices_and_long_signatures():
    notice = "Le présent courriel est établi à l’intention exclusive de ses destinataires et est confidentiel. Toute diffusion est interdite."
    assert newtext.parts_of("Bonjour,\n\noui.\n\n" + notice) == ["disclaimer"] and newtext.newly_written("Oui.\n\n" + notice) == "Oui."
    block = "\n".join(["Ysolde Brandt", *(f"Line {i} of the office" for i in range(20)), "Tel: +1 919 555 0146"])
    assert newtext.newly_written("My answer.\n\nKind regards\n" + block) == "My answer."
    assert newtext.parts_of("The contract is strictly between us and binding for both, we think.") == []


def test_the_gate_loses_no_notice():
    rng = random.Random(2)
    words = [s.strip() for stems in newtext._LEGAL_STEMS for s in stems if s] + ["and", "the", "mail", "we"]
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))
        assert newtext._legal_score(text) < 3 or newtext._may_be_legal(text)


# 5 near-duplicates
def shingles(text, w):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + w]) for i in range(len(words) - w + 1)}


def brute(rows, w, t):
    sets = {i: s for i, x in rows.items() if (s := shingles(x, w))}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_near_duplicates_against_brute_force(spark, data):
    m = table(spark, data, "enron_dataset")
    rows = {r["id"]: (r["subject"] or "") + " " + r["message"] for r in m.collect() if r["message"]}
    assert {tuple(r) for r in neardup.found(m).collect()} == brute(rows, 3, 0.6)


def test_near_duplicates_with_a_hot_group(spark):
    """A third of the rows are copies or edits of one text; lists of common values are split into blocks."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = {}
    for i in range(240):
        text = list(base) if i % 3 == 0 else [rng.choice(words) for _ in range(rng.randint(3, 150))]
        if i % 6 == 0:
            for _ in range(i % 5):
                text[rng.randrange(len(text))] = rng.choice(words)
        rows[i] = " ".join(text)
    df = spark.createDataFrame([(i, x, AT, "clash") for i, x in rows.items()] + [(0, rows[0], AT, "clash"), (900, None, AT, ""), (901, "", AT, "")], "id long, text string, loaded_at timestamp, print string")
    s = neardup.Settings(words=3, threshold=0.6, block=16)
    want = brute(rows, 3, 0.6)
    assert {tuple(r) for r in neardup.pairs_of(df, s).collect()} == want and len(want) > 2000
    groups = {r["id"]: (r["group_id"], r["links"]) for r in neardup.groups_of(df, s).collect()}
    assert all(groups[a][0] == groups[b][0] for a, b in want) and 900 not in groups
    five = {tuple(r) for r in neardup.pairs_of(df, neardup.Settings()).collect()}
    assert five == brute(rows, 5, 0.8)


def test_near_duplicates_of_a_hot_template_extended_by_rare_words(spark):
    """The common part of a pair is frequent and comes last in the order; only one value need be shared before it."""
    base = " ".join(f"t{i}" for i in range(102))
    rows = {i: f"{base} " + " ".join(f"x{i}a{k}" for k in range(400)) for i in range(60)}  # makes the template common
    rows |= {100 + k: f"{base} " + " ".join(f"y{k}a{j}" for j in range(54 + k)) for k in range(13)}  # 0.60 to 0.65 with the template, about
    rows[200] = base
    df = spark.createDataFrame([(i, x, AT) for i, x in rows.items()], "id long, text string, loaded_at timestamp")
    want = brute(rows, 3, 0.6)
    assert len(want) == 13 and all(b == 200 for _, b in want)
    for block in (16, 512):
        assert {tuple(r) for r in neardup.pairs_of(df, neardup.Settings(words=3, threshold=0.6, block=block)).collect()} == want


def test_redelivered_id_with_another_text(spark):
    """Only the first delivery of an id counts, in classes, sketches and full sets alike."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    later = dt.datetime(2024, 2, 1)
    rows = [(1, a, AT), (1, b, later), (5, b, AT), (9, b + " more words", AT), (5, b, later), (7, b, None), (7, a, AT), (8, a, later)]
    df = spark.createDataFrame(rows, "id long, text string, loaded_at timestamp")
    want = {(5, 9), (5, 7), (7, 9), (1, 8)}
    assert {tuple(r) for r in neardup.pairs_of(df, neardup.MAIL).collect()} == want
    got = {r["id"]: (r["group_id"], r["links"]) for r in neardup.groups_of(df, neardup.MAIL).collect()}
    assert got == {1: (1, 1), 8: (1, 1), 5: (5, 2), 7: (5, 2), 9: (5, 2)}


def test_a_class_of_many_copies(spark):
    """Copies of one text meet in blocks; every pair comes out once."""
    members = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(1, 400)] + [(0, 0)], "id long, rep long")
    got = [tuple(r) for r in neardup._within(members, block=50).collect()]
    copies = [0, *(i for i in range(1, 400) if i % 3)]
    assert len(got) == len(set(got)) == len(copies) * (len(copies) - 1) // 2


def test_estimate_is_never_too_low():
    """The similarity that a union sketch leaves open is at least that of the full sets, for any order of values."""
    rng = random.Random(3)
    kept = 0
    for _ in range(4000):
        t, n, extra = rng.choice((0.5, 0.6, 0.8)), rng.randint(2, 30), rng.choice((0, 0.05, 0.2, 1.0))
        x = sorted(rng.sample(range(60), n))
        y = sorted(({*x} | {*rng.sample(range(60), rng.randint(0, 6))}) - {*rng.sample(x, rng.randint(0, n // 2))})
        na, nb = np.array([len(x)]), np.array([len(y)])
        common, c = (int(v[0]) for v in neardup.must_share(na, nb, t, extra))
        zone = lambda s: set(s[: max(0, len(s) - common + c)])
        bottom = lambda s: len(s) - int(np.ceil(t * len(s) - 1e-9)) + 1
        o, true = len(zone(x) & zone(y)), len(set(x) & set(y)) / len(set(x) | set(y))
        if true >= t:
            kept += 1
            assert o >= c >= 1 and neardup.at_most(na, nb, np.array([o]), t, extra)[0] >= true - 1e-9
            assert max(len(zone(x)) - bottom(x), len(zone(y)) - bottom(y)) <= 0  # within the bottom k
        if min(na, nb) >= t * max(na, nb):
            assert (o >= c) == (neardup.at_most(na, nb, np.array([o]), t, extra)[0] >= t - 1e-9) or o + common - c > min(na, nb)
    assert kept > 1000


def test_groups_are_not_cut_short(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(10 * i, 10 * i + 100)), AT) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, text string, loaded_at timestamp")
    with pytest.raises(RuntimeError):
        neardup.groups_of(df, neardup.MAIL, rounds=1)
    assert {r["group_id"] for r in neardup.groups_of(df, neardup.MAIL).collect()} == {0}


# 6 language
def test_language_held_out(spark, data):
    m = table(spark, "/root/testdata/sf0.01", "enron_dataset")
    model = language.train(m.where("id % 5 <> 0"), 1200)
    held = m.where("id % 5 = 0 and message is not null").select("id", F.col("message").alias("text"), language.declared(F.col("lang")).alias("said")).where("said is not null").dropDuplicates(["id"])
    got = language.detect(held, model).join(held.select("id", "said"), "id").where("lang is not null")
    right = got.where("lang = said").count() / got.count()
    assert right > 0.93  # some declared languages are false by design
    reader = language.Reader(model.table(), model.bias, model.temperature)
    text = "The meeting is now in the large room and we counted three open items.\n\nDie Sitzung findet morgen in dem großen Raum statt und wir haben noch keine Antwort."
    assert [x[0] for x in language.stretches(text, reader, model.threshold)] == ["en", "de"]
    assert language.stretches("", reader, 0.5) == [] and language.stretches("123 -- 4", reader, 0.5) == []


def test_language_of_redelivered_mail(spark, data):
    m = table(spark, data, "enron_dataset").select("id", "subject", "message", "lang", "loaded_at")
    later = [(10**9, "", "Die Sitzung findet morgen in dem großen Raum statt und wir haben noch keine Antwort von euch.", "en", AT + dt.timedelta(days=k)) for k in (5, 1)]
    first = [(10**9, "", "The meeting is now in the large room and we counted three open items of the list.", "en", AT)]
    got = language.found(m.union(spark.createDataFrame(later + first, m.schema))).where("id = 1000000000").collect()
    assert got == []


def test_declared_codes(spark):
    want = {"en": "en", "ENG": "en", "nl_NL": "nl", "de-AT": "de", "und": None, "xx": None, "??": None, "": None, "unknown": None, " fra ": "fr", None: None}
    got = spark.createDataFrame([(k,) for k in want], "c string").select("c", language.declared(F.col("c")).alias("d")).collect()
    assert {r["c"]: r["d"] for r in got} == want


# 8 packing
@pytest.mark.parametrize("capacity", [64, 512])
def test_packing(capacity):
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, capacity + 1, 3000), np.full(500, capacity // 3), np.array([capacity]), np.array([1, 1, 1]), np.zeros(0, dtype=np.int64)):
        where = packing.pack(lengths, capacity)
        sums = np.bincount(where, lengths) if len(where) else np.zeros(0)
        assert (sums <= capacity).all() and (sums > 0).all() and (where >= 0).all()
        if len(lengths) > 1000:
            assert lengths.sum() / (capacity * len(sums)) > 0.97


def test_packing_is_never_worse_than_best_fit_and_gains():
    rng = np.random.default_rng(11)
    lengths = np.clip(rng.normal(600, 260, 6000).astype(int), 60, 2048)
    shares = []
    where = packing.pack(lengths, 2048, shares)
    used, built, alone = shares[0]
    assert where.max() + 1 == used <= alone and built > used // 2 and used * 2048 >= lengths.sum()
    assert used < alone


def test_configurations_reach_the_optimum():
    """Three sizes whose best packing is known: every container holds 5 + 3 + 2."""
    demand = np.array([30.0, 30.0, 30.0])
    got = packing.configurations(np.array([50, 30, 20]), demand, 100)
    assert sum(n for n, _ in got) == pytest.approx(30)
    assert all((c * np.array([50, 30, 20])).sum() <= 100 for _, c in got)


def test_packed_documents(spark, data):
    docs, kinds = table(spark, data, "documents"), table(spark, data, "pack_capacity")
    p = packing.packed(docs.withColumn("container", F.lit("clash")).withColumn("shard", F.lit(1)), kinds)
    counts = {r["doc_id"]: r["tokens"] for r in packing.token_counts(docs).collect()}
    caps = {r["container"]: r["capacity_tokens"] for r in kinds.collect()}
    rows = p.collect()
    load, parts = {}, {}
    for r in rows:
        load[r["container"], r["container_no"]] = load.get((r["container"], r["container_no"]), 0) + r["tokens"]
        parts.setdefault((r["container"], r["doc_id"]), []).append(r["tokens"])
    assert all(v <= caps[c] for (c, _), v in load.items())
    assert all(sum(v) == counts[i] and (len(v) == 1 or counts[i] > caps[c]) for (c, i), v in parts.items()) and len(parts) == len(caps) * len(counts)
    for c in caps:
        assert {n for k, n in load if k == c} == set(range(len([1 for k, _ in load if k == c])))


# 9 leaked passages
def naive_edit(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for k, t in enumerate(text, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        p, t = [rng.randrange(4) for _ in range(rng.randint(1, 12))], [rng.randrange(4) for _ in range(rng.randint(0, 25))]
        d = naive_edit(p, t)
        for most in range(4):
            assert leakage.myers(p, t, most) == (d <= most and bool(t)) or not t


def test_leaks(spark):
    item = " ".join(f"word{i}" for i in range(50))
    w = item.split()
    docs = {
        1: "Intro. " + item, 2: "Intro text here " + " ".join(w[5:26]).upper() + ", end.", 3: " ".join(w[5:22]) + " other words follow here and more",
        4: "x " + " ".join(w[10:18] + ["changed"] + w[19:26] + ["also"] + w[27:34]), 5: "y " + " ".join(w[10:15] + ["a"] + w[16:20] + ["b"] + w[21:25] + ["c"] + w[26:30] + ["d"]),
        6: " ".join(w[:12]) + " wor-\nd12 " + " ".join(w[13:24]), 7: " ".join(w[:12]) + "\nCourt of X — 3 LB 38/2016 — Page 3\n" + " ".join(w[12:24]), 8: None, 9: "",
    }
    d = spark.createDataFrame([(k, v, 1) for k, v in docs.items()] + [(1, docs[1], 1), (None, item, 1)], "doc_id long, text string, item_id long")
    i = spark.createDataFrame([(70, item, 1), (70, item, 1), (71, "too short", 1), (72, None, 1)], "item_id long, text string, doc_id long")
    want = {(1, 70), (2, 70), (4, 70), (6, 70), (7, 70)}
    assert {tuple(r) for r in leakage.found(d, i).collect()} == want
    leakage.ITEM_WORDS, old = 10, leakage.ITEM_WORDS
    try:
        assert {tuple(r) for r in leakage.found(d, i).collect()} == want  # in blocks
    finally:
        leakage.ITEM_WORDS = old
    assert leakage.found(d, i.limit(0)).count() == 0 and leakage.found(d.limit(0), i).count() == 0


def test_leaks_with_a_frequent_passage_against_brute_force():
    """All items share a long passage; documents hold parts of items with words changed, dropped and added."""
    rng = random.Random(4)
    shared = [rng.randrange(50) for _ in range(25)]
    items = [[rng.randrange(400) for _ in range(20)] + shared[: rng.randint(0, 25)] + [rng.randrange(400) for _ in range(20)] for _ in range(10)]
    index = leakage.Index.of(list(range(10)), [np.array(x, dtype=np.uint64) for x in items])
    for _ in range(12):
        x = rng.choice(items)
        a = rng.randint(0, len(x) - 18)
        part = x[a : a + rng.randint(15, 30)]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(part))
            part[k : k + rng.randint(0, 1)] = [rng.randrange(400) for _ in range(rng.randint(0, 1))]
        doc = [rng.randrange(400) for _ in range(8)] + part + shared[5:14] + [rng.randrange(400) for _ in range(8)]
        want = {i for i, y in enumerate(items) if any(naive_edit(y[s : s + 20], doc) <= 2 for s in range(len(y) - 19))}
        assert set(index.matches(np.array(doc, dtype=np.uint64))) == want


# 10 cut texts
def test_endings():
    for cut in ("It follows that the bur", "A sentence. The claim was held [more]", "one. In those...", "x.\n\n(6) Mit Schreiben vom 13. November 2002", "a. Am 9.", "done, see Art.", "a�"):
        assert truncated.ends_inside(cut), cut
    for whole in ("ORDER\nThe appeal is dismissed.", "It ends.\n\n(signed) Maren Wyreellio\nRegistrar", "It ends.\n\nDone at Tillermouth, 13 October 2023", "It ends.\n\nEND OF RULING", "It ends.\n\nNames of third parties omitted […]", "Ende.\n\ngez. Ulrike Zellmere", None, "", "  "):
        assert not truncated.ends_inside(whole), whole


DOCS = "doc_id long, text string, source string, body string, size int, hashes array<long>, whole binary"


def test_prefixes(spark):
    full = "This ruling has many words, and it goes on for long. The order is given in Court\nJohn Smith Registrar"
    rows = [(k, full[:n] if n else full, "s") for k, n in enumerate([0, 0, 40, 90, 94, 52])] + [(50, None, "s"), (51, "", None), (52, "This", "s")]
    rows += [(100 + k, f"Other text number {k} is complete.", "t") for k in range(60)]
    docs = spark.createDataFrame([(*r, "clash", 1, [1], b"") for r in rows], DOCS)
    v = {r["doc_id"]: r for r in truncated.verdicts(docs).collect()}
    # 4 ends with "John " where a new line began; 5 ends a sentence
    assert len(v) == 67 and {k for k, r in v.items() if r["prefix"]} == {2, 3, 4}
    assert truncated.shares(docs).where("source = 't'").first()["cut"] == 0


def test_prefixes_normalised(spark):
    """Paragraph numbers, page heads, line breaks and case don't keep a copy from being found; a line that ends with its copy's is no evidence."""
    rows = [(1, "1. The claim was held to be out of ti", "a"), (2, "[7] THE CLAIM\nwas held\nCourt of X — 3 LB 38/2016 — Page 3\nto be out of time, and so on.", "b"), (3, "It ends here.\n\nMaren Holt\n", "a"), (4, "It ends here.\n\nMaren Holt\nAddendum of another day.", "b")]
    v = {r["doc_id"]: r["prefix"] for r in truncated.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert v == {1: True, 2: False, 3: False, 4: False}


def test_prefixes_with_a_hot_group_against_brute_force(spark):
    """A third of the rows are copies of one cut text, and many cuts of one long text lie within one fixed length."""
    rng = random.Random(9)
    words = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(900)]
    long = " ".join(words) + "."
    hot = long[:701]
    rows = [(k, hot, "s") for k in range(5000)] + [(5000, long, "t")] + [(6000 + k, long[: 300 + k], "u") for k in range(300)] + [(7000 + k, f"{k} " + long, "w") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = {r["doc_id"]: r["prefix"] for r in truncated.verdicts(docs).collect()}
    texts = {k: t.strip() for k, t, _ in rows}
    different = set(texts.values())
    cut = {t: any(len(x) > len(t) and x.startswith(t) for x in different) for t in different}
    assert got == {k: cut[t] for k, t in texts.items()} and sum(got.values()) > 5200


def test_marks_behind_a_cut_of_any_length():
    assert truncated.strip_marks("the bur" + "… " * 200) == "the bur" and truncated.ends_inside("It was so. The bur" + "." * 900)


# odd input for all of them
def test_odd_mail(spark):
    odd, empty = mail(spark, ODD), mail(spark, [])
    reports = spark.createDataFrame([(1, None), (2, ""), (None, "a@b.example"), (3, "a@b.example"), (3, "a@b.example")], "report_id long, originalmailfrom string")
    assert {tuple(r) for r in encoding.found(odd).collect()} == {(6, "message")}
    assert canonical.found(odd).count() == 0
    assert {tuple(r) for r in personal.found(odd, reports).collect()} == {("arf_result", 3, "email")}
    assert newtext.found(odd).count() == 0
    assert {tuple(r) for r in neardup.found(odd).collect()} == {(4, 5)}
    assert language.found(odd).count() >= 0
    for df in (encoding.found(empty), canonical.found(empty), personal.found(empty, reports.limit(0)), newtext.found(empty), neardup.found(empty), language.found(empty)):
        assert df.count() == 0


def test_odd_documents(spark):
    kinds = spark.createDataFrame([("a", 10), ("b", None), ("c", 0)], "container string, capacity_tokens int")
    d = "doc_id long, text string, source string, tokens int"
    odd = spark.createDataFrame([(1, None, None, 0), (2, "", "s", 0), (3, LONG, "s", 0), (3, LONG, "s", 0), (None, "x", "s", 0), (4, "word", None, 0)], d)
    p = packing.packed(odd, kinds)
    assert {r["doc_id"] for r in p.collect()} == {3, 4} and p.where("tokens > 10").count() == 0
    assert {r["doc_id"] for r in truncated.found(odd).collect()} <= {3, 4}
    empty = spark.createDataFrame([], d)
    assert packing.packed(empty, kinds).count() == 0 and truncated.found(empty).count() == 0 and packing.packed(odd, kinds.limit(0)).count() == 0
