import pytest
from pyspark.sql import functions as F

from mailgauge.functions.columns import contrast, parsed_label, to_boolean, to_integer, to_number
from mailgauge.operators import classify, css, dom, embedding, hidden, mime, registry
from mailgauge.operators.clean import clean
from mailgauge.plans import catalog

LABELS = [
    ("", None), ("0", 0), (" 1 ", 1), ("LABEL: 1", 1), ("label = <0>", 0), ("Prediction - 1", 1), ("text\nCLASS: [0]", 0), ("(1)", 1), ("LABEL: <0 or 1>", 0), ("LABEL: 10", 1),
    ("**LABEL:** 1", None), ("\n\n1\nmore", 1), ("phishing", None), ("mislabel: 1", None), (None, None), ("a\x0bLabel: 1", 1), ("why classification 0", 0),
]


def test_label_parser(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(LABELS)], "i int, raw string")
    assert [r[0] for r in df.orderBy("i").select(parsed_label(F.col("raw"))).collect()] == [w for _, w in LABELS]


def test_booleans_and_numbers(spark):
    raw = [" TRUE ", "y", "0", "1.0", "", "maybe", None, "F"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").orderBy("i")
    assert [r[0] for r in df.select(to_boolean(F.col("raw"))).collect()] == [True, True, False, None, None, None, None, False]
    assert [r[0] for r in df.select(to_number(F.lit("NaN"))).collect()] == [None] * 8
    assert [tuple(r) for r in spark.range(1).select(to_number(F.lit(" 1.5 ")), to_integer(F.lit("2023.0")), to_integer(F.lit("x"))).collect()] == [(1.5, 2023, None)]


def test_clean_needs_its_columns(spark):
    with pytest.raises(ValueError, match="dataset, email_id"):
        clean(spark.createDataFrame([("a",)], "status string"))


# One element each, whether its text is hidden, and by what.
STYLES = [
    ('<p style="display:none">x</p>', "Visibility control:display:none"), ('<p style="display:none !important">x</p>', None), ('<p style="display:NONE">x</p>', None),
    ('<p style="visibility:hidden">x</p>', "Visibility control:visibility"), ('<p style="opacity:0">x</p>', "Opacity: opacity:0.00"),
    ('<div style="opacity:.1"><div style="opacity:.1"><p style="opacity:.1">x</p></div></div>', "Opacity: opacity:0.00"),
    ('<p style="font-size:0">x</p>', None), ('<p style="font-size:1px">x</p>', "Font too small: 1.0px"), ("<font size=1>x</font>", None),
    ('<p style="color:#fff">x</p>', "Same color: same_color"), ('<p style="color:#fefefe">x</p>', "Contrast: low_contrast(1.01)"), ('<p style="color:transparent">x</p>', "Color transparent: color:transparent"),
    ('<font color="#0000">x</font>', None), ('<table bgcolor="#112233"><tr><td><font color="112233">x</font></td></tr></table>', "Same color: same_color"),
    ('<div style="width:0;overflow:hidden">x</div>', "Clipping area: clipping"), ('<div style="width:5%;overflow:hidden">x</div>', "Clipping area: clipping"), ('<div style="width:200px;overflow:hidden">x</div>', None),
    ('<div style="clip:rect(0,0,0,0)">x</div>', "Clipping area: clipping"), ('<div style="clip:rect(0 0 0 0)">x</div>', None), ('<div style="left:-9999px">x</div>', "Position offset: position_offset"),
    ('<div style="margin-left:-9999px">x</div>', None), ('<a style="margin-left:-9999px">x</a>', "Position offset: position_offset"), ('<p style="text-indent:-9999px">x</p>', "Position offset: position_offset"),
    ('<p style="filter:blur(11px)">x</p>', "Filter: filter_effect"), ('<p style="filter:blur(2px)">x</p>', None), ('<p style="filter:opacity(0)">x</p>', "Filter: filter_effect"),
    ("<style>.a, .b{display:none}</style><p class=a>x</p>", None), ("<style>.a, .b{display:none}</style><p class=b>x</p>", "Visibility control:display:none"),
    ("<style>.d .e{display:none}</style><p class=e>x</p>", "Visibility control:display:none"), ("<style>.f:hover{display:none}</style><p class=f>x</p>", None),
    ("<style>.g{display:none}.g{color:red}</style><p class=g>x</p>", None), ('<p style="background:linear-gradient(#000,#fff)">x</p>', "Same color: same_color"),
    ('<a href=u>x <span style="display:none">y</span></a>', None), ('<p style="color:hsl(0,100%,50%)">x</p>', None), ('<p style="color:rgba(1,2,3,0)">x</p>', "Color transparent: color:transparent"),
]


@pytest.mark.parametrize("html,reason", STYLES)
def test_one_style_at_a_time(html, reason):
    rows, seen = hidden.detect(f"<body>{html}</body>")
    own = [r for r in rows if r["type"] in ("text", "link")]
    assert [r["visible"] for r in own] == [reason is None] * len(own) and own
    if reason:
        assert reason in own[0]["hidden_reasons"]
    assert seen == (reason is None or own[0]["type"] == "link")


def test_strict_mode_gives_error_rows(spark):
    pages = spark.createDataFrame([(1, '<body><p style="filter:opacity(0)">x</p></body>'), (2, "<body>y</body>"), (3, None)], "id int, html string")
    rows = {r["id"]: r for r in hidden.detected(pages, strict=True).collect()}
    assert rows[1]["error"].startswith("StyleError") and rows[1]["fragments"] is None
    assert rows[2]["error"] is None and rows[2]["file_visible"] and rows[3]["fragments"] is None and rows[3]["error"] is None


def test_comments_and_documents_without_body():
    rows, _ = hidden.detect("<html><head><!-- top --></head><body><div><!-- lost --></div><p>a</p></body></html>")
    assert [(r["type"], r["text"]) for r in rows] == [("text", "a"), ("html_comment", "top")]
    rows, _ = hidden.detect("<!DOCTYPE html><p>b</p>")
    assert [r["text"] for r in rows] == ["html", "b"]


def test_tree_is_lenient():
    root = dom.parse("<p>a<p>b</i><br>c<pre> \n </pre>  \n <![CDATA[x]]>")
    assert [str(t) for t in root.strings()][:3] == ["a", "b", "c"]
    deep = "<div>" * 5000 + "x"
    assert hidden.detect(deep)[0][0]["text"] == "x"
    assert dom.visible_text("<title>t</title>a \t b<script>x</script>\n\n\n<b>c</b>") == "a b\n\nc"


def test_colours_and_lengths(spark):
    assert css.colour("#1234") == (0x11, 0x22, 0x33, 0x44 / 255)
    assert css.colour("RED") == (255, 0, 0, 1.0) and css.colour("nonsense") == css.BLACK and len(css.NAMED) == 147
    assert [css.length_px(v) for v in ("1e3px", "auto", "calc(1px)", " 2px", "3pt", "10%", "2em")] == [1.0, None, None, None, pytest.approx(3.999), pytest.approx(1.6), 32.0]
    assert [css.font_size(v) for v in ("3", "10pt", "0rem", "1px !important", "50%")] == ["16px", "13px", "16px", "16px", "50.0%"]
    assert css.contrast(css.BLACK, css.WHITE) == 21.0
    lit = lambda *v: [F.lit(x) for x in v]
    assert spark.range(1).select(contrast(lit(0, 0, 0), lit(255, 255, 255))).first()[0] == 21.0


def strategies(fragments, words=()):
    return embedding.classify([(t, v, k) for t, v, k in fragments], words)


V, H = True, False


@pytest.mark.parametrize("fragments,words,want", [
    ([("Pay", V, "text"), ("xq", H, "text"), ("Pal now", V, "text")], ["paypal"], ["disrupt_word"]),
    ([("Pay", V, "text"), ("xq", H, "text"), ("Pal now", V, "text")], [], ["add_paragraph"]),
    ([("se", V, "text"), ("q", H, "text"), ("cu", V, "text"), ("z", H, "text"), ("rity now", V, "text")], ["security"], ["disrupt_word", "disrupt_word"]),
    ([("ab", V, "text"), ("x" * 80, H, "text"), ("cd", V, "text")], ["abcd"], ["add_paragraph"]),
    ([("PayPal ", V, "text"), ("security", H, "text"), (" account", V, "text")], ["security"], ["insert_word"]),
    ([("k", H, "text"), ("PayPal", V, "text")], ["k"], ["add_paragraph"]),
    ([("a", V, "text"), ("  ", H, "text"), ("b", V, "text")], [], ["hidden_whitespace_only"]),
    ([("[if mso]> x <![endif]", H, "html_comment"), (" ad 0 ", H, "html_comment")], [], ["mso_conditional_comment", "html_comment"]),
    ([("well-", V, "text"), ("q", H, "text"), ("known fact", V, "text")], ["known"], ["add_paragraph"]),
])
def test_embedding(fragments, words, want):
    assert [c for c in strategies(fragments, words) if c] == want


def test_hyphenated_words():
    words = embedding.Words(["well", "known", "email"])
    assert words.real_joined("well-known") and words.real_joined("e-mail") and not words.real_joined("well-kn") and not words.real_joined("")


def test_runs_and_neighbours(spark):
    rows = [("m", i, t, "text" if k != "c" else "html_comment", k == "v", None) for i, (t, k) in enumerate([("A", "v"), ("x", "h"), ("y", "h"), ("c1", "c"), ("c2", "c"), ("z", "h"), (" ", "v"), ("B", "v"), ("", "h")])]
    df = spark.createDataFrame(rows, "key string, frag_idx int, text string, type string, visible boolean, hidden_reasons array<string>")
    got = [(r["text"], r["run_id"], r["prev_visible"], r["next_visible"]) for r in embedding.with_runs(df, "key").orderBy("frag_idx").collect()]
    assert got == [("A", None, None, "B"), ("x", 1, "A", "B"), ("y", 1, "A", "B"), ("c1", 2, "A", "B"), ("c2", 3, "A", "B"), ("z", 4, "A", "B"), (" ", None, "A", "B"), ("B", None, "A", None)]
    runs = {r["run_id"]: r for r in embedding.hidden_runs(embedding.with_runs(df, "key"), "key").collect()}
    assert runs[1]["hidden_text"] == "x y" and runs[1]["splits_word"] and runs[2]["is_comment"]


def test_nearest_visible_of_all_users(spark, sf):
    users = {}
    for e in spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type").orderBy("event_id").collect():
        users.setdefault(e["user_id"], []).append((e["event_id"], e["event_type"], e["event_type"] != "purchase", e["event_id"] % 7 == 0))
    want = set()
    for user, own in users.items():
        run = 0
        for k, (i, kind, visible, comment) in enumerate(own):
            run += not visible and (k == 0 or own[k - 1][2] or comment or own[k - 1][3])
            before, after = [e[1] for e in own[:k] if e[2]], [e[1] for e in own[k + 1 :] if e[2]]
            want.add((user, i, f"{kind} x", None if visible else run, f" {before[-1]}  x" if before else None, f" {after[0]}  x" if after else None))
    got = [tuple(r) for r in catalog.nearest_visible(spark, sf).select("key", "frag_idx", "clean", "run_id", "prev_visible", "next_visible").collect()]
    assert len(got) == len(want) and set(got) == want


def message(*lines):
    return "\r\n".join(lines).encode()


MIXED = message(
    "From: a@x.example", "Subject: hi", 'Content-Type: multipart/mixed; boundary="b"', "", "--b", "Content-Type: text/plain", "", "plain", "--b", "Content-Type: text/html; charset=latin-1", "Content-Transfer-Encoding: base64", "", "PHA+Y2Fm6TwvcD4=",
    "--b", 'Content-Type: image/png; name="i.png"', 'Content-Disposition: inline; filename="i.png"', "Content-Transfer-Encoding: base64", "", "QUJD", "--b--", "",
)


def test_mime_representations():
    m = mime.parse(MIXED)
    assert mime.html_of(m) == "<p>café</p>"
    assert mime.p2(m) == "From: a@x.example\nSubject: hi\n\ncafé\n\nAttachments:\n[Attachment removed: i.png | image/png | 3 bytes]\n"
    p1 = mime.p1(m)
    assert p1.startswith("From: a@x.example\nSubject: hi\n\n--b\nContent-Type: text/plain\n\nplain\n--b\n") and p1.endswith("--b--\n") and "base64" not in p1 and "<p>café</p>" in p1
    plain = mime.parse(message("To: b@x.example", "", "body", ""))
    assert mime.html_of(plain) is None and mime.p1(plain) == mime.p2(plain) == "To: b@x.example\n\nbody\n"
    odd = mime.parse(message("Content-Type: text/html; charset=x-unknown", "", "<p>a</p>"))
    assert mime.html_of(odd) is None and mime.p2(odd).strip() == "a"
    assert mime.p2(mime.parse(b"")) == "\n"


def test_messages_in_spark(spark):
    rows = mime.parsed(spark.createDataFrame([(1, MIXED), (2, None)], "id int, content binary")).collect()
    assert [(r["html"], r["error"]) for r in rows] == [("<p>café</p>", None), (None, None)]
    texts = mime.parser_texts(mime.parsed(spark.createDataFrame([(1, MIXED)], "email_id int, content binary"))).collect()
    assert sorted(r["parser_id"] for r in texts) == ["P1", "P2"]


class Failing(registry.Scorer):
    def generate(self, prompt):
        if "bad" in prompt:
            raise KeyError("x")
        return "LABEL: 1"


def test_status_machine(spark):
    registry.register_scorer("failing", Failing)
    mails = spark.createDataFrame([("a_P1", "P1", "fine"), ("b_P1", "P1", "bad"), ("c_P1", "P1", "long " * 200)], "email_id string, parser_id string, text string")
    for allow, want in ((False, {"a_P1": "ok", "b_P1": "generation_error:KeyError", "c_P1": "skipped_over_context"}), (True, {"a_P1": "ok", "b_P1": "generation_error:KeyError", "c_P1": "ok_over_context"})):
        out = classify.run_models(mails, "failing", 127_800, allow, ["meta-llama/Llama-3.1-8B-Instruct"], ["label"]).collect()
        assert {r["email_id"]: r["status"] for r in out} == want
        assert {r["email_id"]: (r["parse_ok"], r["pred_label"]) for r in out}["b_P1"] == (False, None)


def test_registries():
    with pytest.raises(ValueError, match="known: evidence, guided, label"):
        registry.get_prompt("x")
    with pytest.raises(ValueError, match="unknown model"):
        registry.get_model("x")
    assert registry.build_prompt("label", "hello").endswith("E-mail:\nhello")
    assert classify.output_name("run_POut", "meta-llama/Llama-3.1-8B-Instruct") == "run_LLMOut_llama.csv"


def test_summary_covers_every_email(spark):
    pages = spark.createDataFrame([("a", '<body><p style="color:#fff">x y</p><!-- c --></body>'), ("b", "<body>hello</body>"), ("c", None)], "email_file string, html string")
    found = hidden.detected(pages)
    rows = embedding.classified(hidden.fragment_rows(found, "email_file"), {"hello"}, "email_file")
    out = {r["email_file"]: r for r in hidden.email_summary(pages, found, rows).collect()}
    assert out["a"]["css_same_color"] and out["a"]["html_comment_count"] == 1 and out["a"]["dominant_strategy"] == "add_paragraph"
    assert out["b"]["dominant_strategy"] == "no_hidden_text" and out["b"]["visible_fragment_count"] == 1 and not out["c"]["has_html"] and out["c"]["error"] is None
    stats = {r["flag"]: (r["n_emails"], r["percentage"]) for r in hidden.corpus_stats(hidden.email_summary(pages, found, rows)).collect()}
    assert stats["any_hidden"][0] == 1 and stats["css_same_color"][1] == pytest.approx(100 / 3)


def test_run_over_a_folder(spark, tmp_path):
    for p in ("P1", "P2"):
        (tmp_path / "run_POut" / p).mkdir(parents=True)
        (tmp_path / "run_POut" / p / "a_P1.txt").write_text("please verify")
        (tmp_path / "run_POut" / p / "b_P1.txt").write_text("hello you")
    root, model = f"{tmp_path}/run_POut", "meta-llama/Llama-3.1-8B-Instruct"
    path = classify.run_folder(spark, root, ["P1", "P2"], model, ["label"], f"{tmp_path}/results")
    assert path.endswith("/run_LLMOut_llama.csv")
    rows = spark.read.option("header", True).csv(path).collect()
    assert sorted((r["email_id"], r["parser_id"], r["pred_label"]) for r in rows) == [("a_P1", "P1", "1"), ("a_P1", "P2", "1"), ("b_P1", "P1", "0"), ("b_P1", "P2", "0")]
    for wrong in ([root, ["P3"], model, ["label"]], [root, ["P1"], "no model", ["label"]], [root, ["P1"], model, ["no prompt"]], [f"{tmp_path}/none", ["P1"], model, ["label"]]):
        with pytest.raises(ValueError):
            classify.run_folder(spark, *wrong, f"{tmp_path}/results")


def test_flags_list_their_emails(spark):
    pages = spark.createDataFrame([("m1", '<body>a<span style="display:none">b</span></body>'), ("m2", "<body>c</body>"), ("m3", "<body>c<!-- x --></body>")], "email_file string, html string")
    found = hidden.detected(pages)
    rows = embedding.classified(hidden.fragment_rows(found, "email_file"), {"b"}, "email_file")
    listed = {tuple(r) for r in hidden.flag_emails(hidden.email_summary(pages, found, rows)).collect()}
    assert {("css_display_none", "m1"), ("has_html_comments", "m3"), ("any_hidden", "m1"), ("any_hidden", "m3")} <= listed and "m2" not in {e for _, e in listed}
