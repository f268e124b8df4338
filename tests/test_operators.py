"""Core operators on single cases."""

import pytest
from pyspark.sql import functions as F

from postsieve.functions import idn, text, urls
from postsieve.operators import arf, auth, bayes, detect, rules, verdict
from postsieve.sources.mime import parse_message


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("host,by_rules,by_attributes", [("a.b.org.uk", "org.uk", "b.org.uk"), ("a.b.co.uk", "b.co.uk", "b.co.uk"), ("x.com", "x.com", "x.com")])
def test_root_domain(spark, host, by_rules, by_attributes):
    assert value(spark, urls.root_domain_rules(F.lit(host))) == by_rules
    assert value(spark, urls.root_domain_attributes(F.lit(host))) == by_attributes


def test_srs(spark):
    assert value(spark, urls.undo_srs(F.lit("SRS0=H1=T1=example.com=alice@fwd.net"))) == "alice@example.com"
    assert value(spark, urls.undo_srs(F.lit("SRS1=H=f.net==H1=T1=example.com=alice@g.net"))) == "alice@example.com"


def test_urls(spark):
    t = "See HTTPS://no, https://Example.com:443/a/?b=2&utm_source=x&a=1#top). and https://example.com/a?a=1&b=2"
    assert value(spark, urls.urls(F.lit(t))) == ["https://no", "https://example.com/a?a=1&b=2"]
    s = value(spark, urls.public_suffix(F.lit("subdomain.example.co.uk")))
    assert (s["domain"], s["sld"], s["suffix"], s["subdomain"], s["is_ip"]) == ("example.co.uk", "example", "co.uk", "subdomain", False)
    assert value(spark, urls.public_suffix(F.lit("192.168.1.1")))["is_ip"]


@pytest.mark.parametrize("subject,score", [("YOU WON $1,000,000!!!", 2), ("hello", 0), (None, 0), ("FREE MONEY AND PRIZES", 3)])
def test_subject(spark, subject, score):
    assert value(spark, rules.subject_rules(F.lit(subject).cast("string")))["score"] == score


def test_body_and_keywords(spark):
    both = lambda t: value(spark, rules.body_rules(F.lit(t), F.lit(None).cast("string")))["score"] + value(spark, rules.keyword_rules(F.lit(t)))["score"]
    assert both("Western Union") == 4
    assert both("please unsubscribe") == -1


def test_sender_and_links(spark):
    assert value(spark, rules.sender_rules(F.lit("bob1234@mail.tk"), F.lit(None).cast("string")))["score"] == 4
    assert value(spark, rules.link_rules(F.lit("http://10.0.0.1:8080/x")))["score"] == 2
    assert value(spark, rules.anchor_rules(F.lit('<a href="http://a.com/">http://b.com</a>')))["score"] == 3


def test_exchange(spark):
    r = value(spark, rules.exchange_rules(F.lit("x.outbound.protection.outlook.com"), F.lit("CAT:HPHSH;SFV:NSPM"), F.lit("")))
    assert (r["score"], r["category"]) == (15, "PHISHING")


def test_auth_score(spark):
    r = value(spark, auth.score(*(F.lit(x) for x in ("pass", "softfail", "fail", "none"))))
    assert r["score"] == 3 and r["tests"] == ["DKIM_PASS(-2)", "SPF_SOFTFAIL(1)", "DMARC_FAIL(4)"]


def test_homographs(spark):
    none = F.lit(False)
    assert value(spark, idn.risk(F.lit("paypal.com"), F.lit(""), none)) == pytest.approx(0.7)
    assert value(spark, idn.risk(F.lit("example.com"), F.lit(""), none)) == 0
    assert value(spark, idn.risk(F.lit("pаypal.com"), F.lit(""), none)) > 0.6
    assert value(spark, idn.context_score(F.lit("urgent: suspended, click here"), none)) > 0.3
    assert value(spark, idn.scripts(F.lit("pаypal"))) == ["Latin", "Cyrillic"]


@pytest.mark.parametrize("name,kind", [("a.docm", "office_document"), ("a.doc", "legacy_office"), ("a.vbs", "script"), ("a.docx", None)])
def test_attachments(spark, name, kind):
    assert value(spark, detect.macro_by_name(F.lit(name))) == kind


def test_detectors(spark):
    assert value(spark, detect.file_paths(F.lit("and/or this"))) == ["/or thi"]
    assert value(spark, detect.date_spam(F.lit(" ".join(["01/02/2024"] * 6)))) and not value(spark, detect.date_spam(F.lit(" ".join(["01/02/2024"] * 5))))
    assert value(spark, detect.macro_text(F.lit('Sub AutoOpen() Shell "x"'))) == ["vba"]
    assert value(spark, detect.executable_by_content(F.lit(b"MZ\x00\x00"))) == "exe"


def test_toxicity_reads_whole_texts(spark):
    none = F.lit(None).cast("string")
    long = "word " * 2000 + "end"
    assert value(spark, detect.toxicity_input(none, F.lit(long), none)) == long
    assert value(spark, detect.toxicity_input(none, F.lit(long), none, 5000)) == long[:5000]
    assert value(spark, detect.toxicity_input(none, F.lit("short"), none, 5000)) is None


def test_languages(spark):
    for code, want in {"eng": "en", "zho": "zh", "jpn": "ja", "DE": "de", "qqq": "en"}.items():
        assert value(spark, text.language_code(F.lit(code))) == want
    assert [value(spark, text.locale(F.lit(x))) for x in ("en-US", "EN", "nb")] == ["en", "en", "no"]
    assert value(spark, text.language_guard(F.lit("123 !@# 456")))


def test_preprocess(spark):
    t = value(spark, text.preprocess(F.lit("card 4111 1111 1111 1111, u r late"), [("u r", "you are")]))
    assert "CREDIT_CARD" in t and "you are" in t
    assert value(spark, text.preprocess(F.lit("  "))) == ""
    assert value(spark, text.half_width(F.lit("ＡＢ１"))) == "AB1"


def test_verdict(spark):
    on, off = F.lit(True), F.lit(False)
    assert value(spark, verdict.message({"phishing": on, "macros": on, "arbitrary": on}, off, off)) == "Spam (phishing detected, macro detected, and arbitrary patterns)"
    assert value(spark, verdict.message({"phishing": off}, off, off)) == "Ham"
    assert value(spark, verdict.weighted_score({"phishing": F.lit(1), "executables": F.lit(1)}, F.lit(0.5), F.lit(0), off, off, off)) == 15
    assert value(spark, verdict.weighted_score({"phishing": F.lit(1)}, F.lit(0.5), F.lit(0), off, off, on)) == 2
    h = value(spark, verdict.headers(F.lit(6.0), on, F.array(F.lit("PHISHING_DETECTED"))))
    assert h["X-Spam-Flag"] == "YES" and "6.0" in h["X-Spam-Status"]
    assert value(spark, verdict.rewrite(F.lit("Subject: a\nTo: b\n\nbody"), F.lit("X-Spam-Flag: YES"), F.lit("[SPAM]"))) == "Subject: [SPAM] a\nTo: b\nX-Spam-Flag: YES\n\nbody"


def test_arf(spark):
    raw = arf.create(F.lit(1), F.lit("custom-type"), F.lit("Agent/1"), F.lit("192.168.1.100"), F.lit("<a@b.example>"), F.array(F.lit("c@d.example"), F.lit("e@f.example")), F.lit("Thu, 8 Mar 2005 14:00:00 +0000"), F.lit("text"), F.lit("Subject: x\n\ny"))
    df = spark.range(1).select(raw.alias("raw"))
    a = arf.parse(df).first()["arf"]
    assert (a["feedback_type"], a["original_feedback_type"], a["source_ip"], a["original_mail_from"]) == ("other", "custom-type", "192.168.1.100", "a@b.example")
    assert a["original_rcpt_to"] == ["c@d.example", "e@f.example"] and a["version"] == "1" and a["incidents"] == 1 and a["arrival_date"].year == 2005
    assert arf.parse(spark.createDataFrame([("hello",), (None,)], "raw string")).where("arf is null").count() == 2


def test_bayes(spark):
    docs = spark.createDataFrame([("spam", ["win", "money"]), ("spam", ["win", "prize"]), ("ham", ["meeting", "report"]), ("ham", ["report", "budget"])], "category string, tokens array<string>")
    m = bayes.train(docs)
    new = spark.createDataFrame([(1, ["win", "money", "now"]), (2, ["report", "meeting"]), (3, [])], "id long, tokens array<string>")
    assert {r["id"]: r["category"] for r in bayes.classify(new, m).collect()} == {1: "spam", 2: "ham", 3: "ham"}
    p = {(r["id"], r["category"]): r["probability"] for r in bayes.probabilities(new, m).collect()}
    assert p[1, "spam"] > 0.8 and abs(p[2, "ham"] + p[2, "spam"] - 1) < 1e-9
    twice = bayes.merge(m, m)
    assert {tuple(r) for r in twice.prior.collect()} == {("spam", 4), ("ham", 4)}


def test_mime():
    raw = b"From: a@b.example\r\nSubject: x\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nhello\r\n--q\r\nContent-Disposition: attachment; filename=h.exe\r\nContent-Type: application/octet-stream\r\nContent-Transfer-Encoding: base64\r\n\r\nTVo=\r\n--q--\r\n"
    m = parse_message("s", raw)
    assert m["subject"] == "x" and m["text"].strip() == "hello" and m["attachments"][0]["filename"] == "h.exe" and m["attachments"][0]["content"] == b"MZ"
    assert parse_message("s", None)["text"] is None or parse_message("s", None)["text"] == ""


def test_mbox(spark, tmp_path):
    from postsieve.sources.mbox import MBOX_NAMES, read_mbox

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mbox").write_text("From x\nSubject: 1\n\n>From me\nFrom y\nSubject: 2\n\nb\n")
    (tmp_path / "in" / "b.txt").write_text("From z\nSubject: 3\n\nc")
    rows = read_mbox(spark, str(tmp_path / "in"), MBOX_NAMES, number=True).orderBy("number").collect()
    assert [(r["number"], r["raw"]) for r in rows] == [(0, "Subject: 1\n\nFrom me\n"), (1, "Subject: 2\n\nb\n")]
    assert {r["raw"] for r in read_mbox(spark, str(tmp_path / "in")).collect()} == {"Subject: 1\n\nFrom me\n", "Subject: 2\n\nb\n", "Subject: 3\n\nc\n"}


def test_mbox_over_many_tasks(spark, tmp_path):
    """A file that is split between tasks gives each message once, in order."""
    from postsieve.sources.mbox import read_mbox

    (tmp_path / "big.mbox").write_text("".join(f"From a{i}\nSubject: {i}\n\n{'x' * (i % 700)}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = read_mbox(spark, str(tmp_path / "big.mbox"), number=True)
        got = df.select("number", F.regexp_extract("raw", r"Subject: (\d+)", 1).cast("int").alias("s")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["number"], r["s"]) for r in got) == [(i, i) for i in range(3000)]


def test_numbering_of_two_hot_groups(spark):
    from postsieve.operators import datasets

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g")).repartition(6)
    got = datasets.numbered(df, ["g"], ["v"]).collect()
    for g in "ab":
        values = sorted(r["v"] for r in got if r["g"] == g)
        assert [(r["v"], r["k"], r["n"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["k"])] == [(v, k, len(values)) for k, v in enumerate(values, 1)]
    assert datasets.numbered(df.limit(0), [], ["v"]).count() == 0


def test_vocabulary_limit(spark):
    docs = spark.createDataFrame([("spam", ["a", "a", "b"]), ("ham", ["a", "c", "d"])], "category string, tokens array<string>")
    assert {r["token"] for r in bayes.train(docs, limit=2).counts.collect()} == {"a", "c"}
    empty = bayes.train(docs.limit(0), limit=5)
    assert bayes.classify(spark.createDataFrame([(1, ["a"])], "id long, tokens array<string>"), empty).first()["category"] is None


def test_categoriser_is_classify(spark):
    docs = spark.createDataFrame([("spam", ["win", "money"]), ("spam", ["win", "prize"]), ("ham", ["meeting", "report"])], "category string, tokens array<string>")
    new = spark.createDataFrame([(1, ["win", "money", "now"]), (2, ["report"]), (3, []), (4, None)], "id long, tokens array<string>")
    m = bayes.train(docs, limit=100)
    one = {r["id"]: r["category"] for r in bayes.classify(new, m).collect()}
    assert {r["id"]: r["c"] for r in new.select("id", bayes.categoriser(m)(F.col("tokens")).alias("c")).collect()} == one


def test_stream(spark, tmp_path):
    from postsieve.streaming.scan import read_mail_stream, scan_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"message_id": 1, "subject": "FREE PRIZE", "text": "western union wire transfer lottery"}\n{"message_id": 2, "subject": "Hi", "text": "see you"}\n')
    q = scan_stream(read_mail_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("scanned").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert {r["message_id"]: r["is_spam"] for r in spark.table("scanned").collect()} == {1: True, 2: False}


def test_stream_replies_and_totals(spark, tmp_path):
    from postsieve.streaming import scan as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"message_id": 1, "subject": "FREE PRIZE", "text": "western union wire transfer lottery"}\n{"message_id": 2, "subject": "Hi", "text": "see you"}\n')
    scanned = S.scan_stream(S.read_mail_stream(spark, str(tmp_path / "in")))
    S.reply(scanned, str(tmp_path / "out"), str(tmp_path / "c"), available_now=True).awaitTermination(120)
    got = spark.read.json(str(tmp_path / "out"))
    assert {(r["message_id"], r["message"]) for r in got.collect()} == {(1, "Spam (arbitrary patterns)"), (2, "Ham")}
    q = S.scan_metrics(scanned).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination(120)
    assert tuple(spark.table("totals").first())[:2] == (2, 1)


def test_scan_of_parsed_messages(spark):
    """Raw messages through the parser into the scan: attachments, pages and header lines count."""
    from postsieve.plans.scan import Config, scan
    from postsieve.sources.mime import parse_mail

    exe = "From: a@b.example\nDate: x\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/plain\n\nhello\n--q\nContent-Disposition: attachment; filename=h.exe\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n\nTVo=\n--q--\n"
    gtube = "From: a@b.example\nX-Test: XJS*C4JDBQADN1.NSBN3*2IDNEN*GTUBE-STANDARD-ANTI-UBE-TEST-EMAIL*C.34X\n\nhi"
    ms = "From: a@b.example\nReceived: from x.outbound.protection.outlook.com (h [192.0.2.1])\nX-Forefront-Antispam-Report: SCL:9;CAT:MALW\n\nhi"
    df = spark.createDataFrame([(1, exe), (2, gtube), (3, ms), (4, "From: a@b.example\n\nhi"), (5, "")], "id int, raw string")
    parsed = parse_mail(df.withColumn("id", F.col("id").cast("string")), "id", "raw").withColumnRenamed("message_id", "message_id_header").withColumn("message_id", F.col("source").cast("int")).drop("date")
    got = {r["message_id"]: r for r in scan(parsed, config=Config(as_of="2024-01-01 00:00:00")).collect()}
    assert [got[i]["message"] for i in range(1, 6)] == ["Spam (executable content)", "Spam (arbitrary patterns)", "Spam (arbitrary patterns)", "Ham", "Ham"]
    assert got[3]["subtype"] == "malware" and got[3]["reasons"][0] == "MS_HIGH_CONFIDENCE_THREAT: CAT:MALW"
    assert scan(parsed.limit(0)).count() == 0


def test_rewrite_beyond_the_basic_plane(spark):
    assert value(spark, verdict.rewrite(F.lit("Subject: 𝐚𝐛\r\n\r\nb"), F.lit("X: $1\\"), F.lit(None).cast("string"))) == "Subject: 𝐚𝐛\r\nX: $1\\\r\n\r\nb"


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("generalizations", "gener"), ("oscillators", "oscil"), ("sky", "sky"), ("happy", "happi")])
def test_stems(word, want):
    from postsieve.functions.stem import porter

    assert porter(word) == want


def test_models_and_corpora(spark, tmp_path):
    from postsieve.sources import sinks

    m = bayes.train(spark.createDataFrame([("spam", ["win"]), ("ham", ["report"])], "category string, tokens array<string>"))
    sinks.save_model(m, str(tmp_path / "m"))
    assert {tuple(r) for r in sinks.load_model(spark, str(tmp_path / "m")).counts.collect()} == {("spam", "win", 1), ("ham", "report", 2)}
    sinks.write_corpus(spark.createDataFrame([("s", "m", "ham")], "subject string, message string, label_text string"), str(tmp_path / "c"))
    assert (tmp_path / "c" / "label_text=ham").is_dir()


def test_corpora_and_training_files(spark, tmp_path):
    from postsieve.sources import mime, sinks

    for label, name, text in (("ham", "1.txt", "Subject: a\n\nhello"), ("spam", "2.txt", "Subject: b\n\nwin"), ("spam", "skip.zip", "x")):
        (tmp_path / "c" / label).mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / label / name).write_text(text)
    rows = mime.read_corpus(spark, str(tmp_path / "c"), ignore=r"\.zip\z").collect()
    assert {(r["label"], bytes(r["content"])) for r in rows} == {("ham", b"Subject: a\n\nhello"), ("spam", b"Subject: b\n\nwin")}
    (tmp_path / "m.eml").write_text("Subject: x\n\nbody")
    assert mime.read_eml(spark, str(tmp_path)).first()["subject"] == "x"
    (tmp_path / "j.json").write_text('[{"id": 1, "subject": "s", "message": "m", "label": 0, "label_text": "ham"}, {"id": 2, "label": 1}]')
    assert {(r["id"], r["label"]) for r in mime.read_training_json(spark, str(tmp_path / "j.json")).collect()} == {(1, 0), (2, 1)}
    (tmp_path / "l.json").write_text('{"id": 3, "label": 1}\n{"id": 4, "label": 0}\n')
    assert mime.read_training_json(spark, str(tmp_path / "l.json")).count() == 2
    sinks.write_json(spark.createDataFrame([(1, "a")], "id int, m string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["m"] == "a"
    docs = spark.createDataFrame([("ham", ["a", "b"]), ("spam", ["a"]), ("spam", [])], "category string, tokens array<string>")
    assert tuple(sinks.training_summary(docs, 10).first()) == (3, 1, 2, 2, 10)


def test_toxic_labels(spark):
    from postsieve.operators import toxicity

    rows = [(f"you are a fool number {i}", 1, 0) for i in range(20)] + [(f"i will hurt you {i}", 0, 1) for i in range(20)] + [(f"see you at lunch {i}", 0, 0) for i in range(20)]
    m = toxicity.train_labels(spark.createDataFrame(rows, "text string, insult int, threat int"), ("insult", "threat"))
    texts = spark.createDataFrame([(1, "such a fool you are"), (2, "i will hurt you"), (3, "lunch at noon"), (4, None)], "id int, text string")
    got = {(r["id"], r["label"]) for r in toxicity.score_labels(m, texts, 0.6).collect()}
    assert (1, "insult") in got and (2, "threat") in got and not any(i in (3, 4) for i, _ in got)


def test_images(spark):
    from postsieve.operators import toxicity

    df = spark.createDataFrame([(1, "a.png", bytes.fromhex("89504E470D0A1A0A0000")), (1, "b.txt", b"hello"), (2, "c.jpg", b"\xff\xd8\xff\xe0"), (3, None, None)], "message_id int, filename string, content binary")
    got = toxicity.image_scores(df, lambda s: s.map(lambda b: len(b) / 10)).collect()
    assert {(r["message_id"], r["kind"], r["flagged"]) for r in got} == {(1, "png", True), (2, "jpeg", False)}


def test_virus_signatures(spark):
    import hashlib

    df = spark.createDataFrame([(1, "a", b"bad"), (2, "b", b"good"), (3, "c", None)], "message_id int, filename string, content binary")
    known = spark.createDataFrame([(hashlib.sha256(b"bad").hexdigest(), "Test.Bad")], "sha256 string, name string")
    assert [tuple(r) for r in detect.virus_hits(df, known).collect()] == [(1, "a", "Test.Bad")]


def test_windowed(spark):
    import datetime as dt

    from postsieve.streaming.scan import windowed

    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 1, 5)), (2, dt.datetime(2024, 1, 1, 1, 50)), (3, dt.datetime(2024, 1, 1, 2, 0))], "message_id int, received_at timestamp")
    assert sorted(r["n"] for r in windowed(df).collect()) == [1, 2]


@pytest.mark.parametrize("lang", ["de", "es", "fr", "it", "pt", "ru"])
def test_stemmers_take_any_word(lang):
    """Odd words don't fail, a stem is never longer than its word by more than an ending's change, and stemming again keeps short words."""
    import random

    from postsieve.functions.snowball import stem

    rng = random.Random(1)
    letters = "abcdeghilmnoprstuvzäöüßéèñçãõà" if lang != "ru" else "абвгдеёиклмнопрстуыьэюяшщ"
    for _ in range(3000):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        assert len(stem(w, lang)) <= len(w) + w.count("ß") + 1
    assert stem("", lang) == "" and stem("a", lang) == "a" and stem("x1-2", lang)
