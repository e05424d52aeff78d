import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from voxframe.functions import textrules as tr
from voxframe.functions.edits import distance, word_edits
from voxframe.operators import text as ops


@pytest.fixture(scope="module")
def one(spark):
    def run(make, *values):
        names = [f"c{i}" for i in range(len(values))]
        df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
        return df.select(make(*[F.col(n) for n in names]).alias("x")).first().x

    return run


def test_chunks(one):
    assert one(tr.chunks, "Hello there. World is great.") == ["Hello there."]
    assert "World" in one(tr.remainder, "Hello there. World is great.")
    assert one(tr.chunks, "Hello there") == []
    assert one(tr.remainder, "Hello there") == "Hello there"
    assert one(tr.chunks, "One line\n\n\nok. A. Next") == ["One line", "ok."]
    assert len(one(tr.chunks, "abc. " * 70)) == 70
    assert len(one(lambda t: tr.chunks(t, 50), "abc. " * 70)) == 50


@pytest.mark.parametrize(
    "text,want",
    [
        ("Brother, rise now.", [("Brother", "comma"), ("rise now", "period")]),
        ("Rise — for the Emperor!", [("Rise", "dash"), ("for the Emperor", "exclamation")]),
        ("Wait.... no,, yes\nok", [("Wait", "ellipsis"), ("no", "comma"), ("yes", "newline"), ("ok", "end")]),
        ("a..b…c", [("a", "ellipsis"), ("b", "ellipsis"), ("c", "end")]),
        ("...", []),
    ],
)
def test_strokes(one, text, want):
    assert [(s.text, s.delimiter) for s in one(tr.strokes, text)] == want


def test_emotion(one):
    shout = one(tr.detect_emotion, "WHAT THE HELL")
    assert shout.emotion == "angry" and "caps-lock" in shout.signals
    quiet = one(tr.detect_emotion, "the table is set")
    assert (quiet.emotion, quiet.confidence, quiet.signals) == ("neutral", 0.0, [])
    # sarcastic 1 and cute 1: the later class wins
    assert one(tr.detect_emotion, "clearly ~").emotion == "cute"
    assert one(tr.detect_emotion, "ОПЯТЬ сломал").emotion == "angry"


def test_numbers(one, spark):
    said = {0: "ноль", 2001: "две тысячи один", 21000019: "двадцать один миллион девятнадцать", -5: "минус пять"}
    for n, words in said.items():
        assert spark.range(1).select(tr.number_words(F.lit(n).cast("bigint")).alias("x")).first().x == words
    big = {
        1_000_000_000: "один миллиард",
        -2_005_000_000_011: "минус два триллиона пять миллиардов одиннадцать",
        -(2**63): "минус девять квинтиллионов двести двадцать три квадриллиона триста семьдесят два триллиона тридцать шесть миллиардов "
        "восемьсот пятьдесят четыре миллиона семьсот семьдесят пять тысяч восемьсот восемь",
    }
    for n, words in big.items():
        assert spark.range(1).select(tr.number_words(F.lit(n).cast("bigint")).alias("x")).first().x == words
    assert one(tr.normalise_numbers, "v2 и 3.14, 50% и -7") == "v2 и 3.14, пятьдесят процентов и минус семь"
    assert one(tr.normalise_numbers, "конец 5.") == "конец 5."
    assert one(tr.normalise_numbers, "3D mp4 a-5") == "3D mp4 a-5"
    assert one(tr.normalise_numbers, "12345678901234567890") == "12345678901234567890"


def test_markdown(one):
    text = "# Head\n**bold** and `x` [l](u)\n| a | b |\n|---|---|\n| c | d |\n- item\n1. one\n```py\ncode\n``` end /path z"
    assert one(tr.strip_markdown, text) == "Head\nbold and  l\na   b\nc   d\nitem\none\n end z"


def code_free(text):
    block = inline = False
    run, out = 0, ""
    for ch in text:
        if ch == "`":
            run += 1
            continue
        if run >= 3:
            block = not block
        elif run and not block:
            inline = not inline
        run = 0
        if not block and not inline:
            out += ch
    return out


@pytest.mark.parametrize("text", ["a ```x `y` z``` b `inl` c", "`a ```b` c``` d", "``q`` r", "no code", "tail ```open", "``` `` a ``` b"])
def test_remove_code(one, text):
    assert one(tr.remove_code, text) == code_free(text)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize(
    "a,b,want",
    [("a b c d", "a x c d", 1), ("Подойди-ка, надо.", "подойди ка надо", 0), ("a b c", "", 3), ("", "x", 1), ("b a", "a b", 2)],
)
def test_word_edits(one, a, b, want):
    assert one(lambda x, y: word_edits(tr.wer_tokens(x), tr.wer_tokens(y)), a, b) == want


def test_turn_wer_brute_force(spark):
    from voxframe.plans.dialogue import turn_wer

    sf = "/root/testdata/sf0.001"
    got = {(r.conv_id, r.turn): (r.edits, r.ref_words) for r in turn_wer(spark, sf).collect()}
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    tokens = lambda t: re.sub(r"[\W_]", " ", t.lower()).split()
    for (conv, turn), found in list(got.items())[:12]:
        ref, hyp = tokens(turns[(conv, turn - 1)]), tokens(turns[(conv, turn)])
        assert found == (edit_distance(ref, hyp), len(ref))


@pytest.mark.parametrize(
    "line,event,fields",
    [
        ("x Processed 20/126 files, 0.08 hours y", "vq_progress", {"files": 20, "total": 126, "hours": 0.08}),
        ("step=5 loss=0.25", "training_step", {"step": 5, "loss": 0.25}),
        ("[train] DONE", "done", {}),
        ("a UserWarning: b", None, {}),
        ("   ", None, {}),
        ("hello", "log", {"message": "hello"}),
        ("weights already cached at /a/b", "checkpoint_cached", {"path": "/a/b"}),
        ("[train] model saved to /out", "model_saved", {"path": "/out"}),
        ("RuntimeError: CUDA out of memory", "oom", {"message": "RuntimeError: CUDA out of memory"}),
        ("[train] 63 WAV files", "dataset_ready", {"wav_files": 63, "transcripts": 0}),
        ("1.2M Trainable params 3.4 G Total params", "model_loaded", {"trainable": "1.2M", "total_params": "3.4 G"}),
    ],
)
def test_log_lines(one, line, event, fields):
    got = one(tr.log_event, line).asDict()
    assert got.pop("event") == event
    if event:
        assert {k: v for k, v in got.items() if v is not None} == fields


def test_storyboard(spark):
    rows = [(1, "[E:5.0 A:0.0 W:9.9] loud\n\nplain\n[warm] soft\n[odd] stays\n[rage]")]
    got = ops.parse_storyboard(spark.createDataFrame(rows, "id int, text string"), ["id"]).orderBy("line_no").collect()
    assert [(r.beat, r.exaggeration, r.cfg_weight, r.temperature) for r in got] == [
        ("loud", 1.7, 0.1, 1.3),
        ("plain", 0.5, 0.5, 0.8),
        ("soft", 0.7, 0.4, 1.0),
        ("[odd] stays", 0.5, 0.5, 0.8),
    ]


def test_shades(spark):
    names = ["WARM", "Intense+Loose+Hot", "hot + flat+firm", "Flat+Calm+Hot", "a+b", "zz"]
    got = ops.resolve_shades(spark.createDataFrame([(n,) for n in names], "shade string")).collect()
    values = {r.shade: (r.exaggeration, r.cfg_weight, r.temperature) for r in got}
    assert values["WARM"] == (0.7, 0.4, 1.0) and values["Intense+Loose+Hot"] == (1.2, 0.6, 1.2)
    assert values["hot + flat+firm"] == (0.3, 0.2, 1.2)
    assert values["Flat+Calm+Hot"] == values["a+b"] == values["zz"] == (0.5, 0.5, 0.8)


@pytest.mark.parametrize(
    "raw,text,want",
    [
        ("PREFIX: Well,", "It works.", "Well, It works."),
        ("SUFFIX: , eh", "It works!", "It works, eh!"),
        ("MID: you know", "One, two.", "One, you know, two."),
        ("MID: you know", "One two", "One two, you know."),
        ("\n plain \n", "Ok?", "Ok, plain?"),
        ("  ", "Ok?", "Ok?"),
    ],
)
def test_commentary(spark, raw, text, want):
    df = spark.createDataFrame([(raw, text)], "raw string, text string")
    assert ops.apply_commentary(ops.parse_commentary(df)).first().spoken == want


def test_stress(spark):
    words = spark.createDataFrame([("замок", "за́мок"), ("мука", "мука́")], "bare string, accented string")
    texts = spark.createDataFrame([(1, "Замок и МУКА, x замок!"), (2, "нет")], "id int, text string")
    got = {r.id: r.annotated for r in ops.dictionary_annotator(words, ["id"])(texts).collect()}
    assert got == {1: "За́мок и МУКА́, x за́мок!", 2: "нет"}


def test_stress_moves_each_text_once(spark):
    """Rows with equal or null keys, words met often and a dictionary with two forms give what joining each token gave."""
    words = spark.createDataFrame([("замок", "за́мок"), ("замок", "замо́к"), ("мука", "мука́"), ("нет", None), (None, "x")], "bare string, accented string")
    rows = [(1, "Замок, мука! 😀 нет"), (2, "мука " * 500), (3, "МУКА и"), (3, "мука да"), (None, "мука"), (None, "мука"), (4, ""), (5, None), (6, ", ")]
    out = ops.annotate_stress(spark.createDataFrame(rows, "id int, text string"), words, ["id"])
    got = {r.id: r.annotated for r in out.collect()}
    assert out.count() == len(got) == 5
    assert got == {1: "За́мокЗамо́к, мука́! 😀 нет", 2: "мука́ " * 500, 3: "МУКА́мука́  даи", None: "мука́мука́", 6: ", "}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "posexplode" not in plan
    named = ops.annotate_stress(spark.createDataFrame([(1, "Мука, мука1 \\ x-y")], "id int, text string"), words, ["id"], letters=r"\p{L}&&[^x]")
    assert named.first().annotated == "Мука́, мука́1 \\ x-y"


@pytest.mark.parametrize("letters", [ops.CYRILLIC, "A-Za-zÀ-ÖØ-öø-ÿ", r"\p{Lu}\-\]^", "😀-😂a", r"a&&b"])
def test_letters_mean_the_same_in_both_engines(spark, letters):
    chars = [chr(i) for i in range(0x110000) if i % 7 == 0 or i < 0x500 or 0x1F5F0 < i < 0x1F610 if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").where(F.col("c").rlike(f"[{letters}]")).collect()
    same = ops.same_letters(spark.range(1), letters)
    assert {r.c for r in rows} == ({c for c in chars if re.match(f"[{same}]", c)} if same else set())


def test_placement(one):
    question = one(tr.placement_scores, "is it, really?")
    assert question.suffix == 0.0 and question.mid == pytest.approx(0.4)
    assert one(tr.placement_scores, "single clause").mid == 0.0
    empty = one(tr.placement_scores, "")
    assert (empty.prefix, empty.mid, empty.suffix) == (0.0, 0.0, 0.0)


def test_technical_words_in_any_case(spark):
    """The quick test lets through all that the rule takes, odd capitals and letters that fold to them included."""
    texts = ["", None, "an API call", "aPı", "APİ", "x", "hTtPs", "Коммиты", "деᲀлой", "ЛОГ", "бᲂг БАГ", "ẖttp", "straße", "API\u0307"]
    for w in tr.TECH_WORDS.strip("()").split("|"):
        texts += [w, w.upper(), w.title(), w[:-1], f"ß{w}ß"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", F.col("t").rlike(f"(?iu){tr.TECH_WORDS}").alias("want"), tr.names_tech(F.col("t")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    # every letter that the rule takes for one of theirs has it as lower case, or is listed
    letters = "".join(sorted(set(re.sub(r"\W", "", tr.TECH_WORDS))))
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    taken = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").where(char.rlike(f"(?iu)[{letters}]")).select(char.alias("c"), F.lower(char).alias("low"))
    found = taken.collect()
    assert len(found) > 2 * len(letters.lower())
    assert all(set(r.low) & set(letters.lower()) or r.c in tr.ODD_FOLDS for r in found)


def test_augmentation_is_seeded_and_keeps_text(spark):
    pools = spark.createDataFrame([("prefix", "Well", 1.0), ("mid", "hm", 1.0), ("suffix", ", eh", 1.0)], "slot string, term string, weight double")
    rows = [(i, f"Line {i} goes on, and on. Then it ends?") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string")
    run = lambda seed, p=1.0: {r.id: r.augmented for r in ops.augment_sentences(df, pools, p, "id", seed).collect()}
    first = run(1)
    assert first == run(1) and first != run(2)
    assert run(1, 0.0) == dict(rows)
    for i, text in rows:
        plain = re.sub(r"Well | hm,|, eh", "", first[i])
        assert plain == text


def test_insertions_move_each_text_once(spark):
    """Terms with commas make clauses of their own, equal and null ids draw alike, and no sentence is shuffled."""
    pools = spark.createDataFrame([("prefix", "So, well,", 1.0), ("mid", "hm", 1.0), ("suffix", ", eh", 1.0)], "slot string, term string, weight double")
    rows = [(i, "one, two, three, four. Is it five, six!? Yes?! end") for i in (*range(60), 7, 7, None, None)] + [(100, None), (101, ""), (102, " "), (103, "...")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = ops.augment_sentences(df, pools, 2.0, "id", 3)
    got = {}
    for r in out.collect():
        assert r.augmented == got.setdefault(r.id, r.augmented)
    assert out.count() == len(rows) and got[100] is None and got[101] == ""
    for i, text in dict(rows[:64]).items():
        plain = re.sub(r"So, well, |, eh", "", got[i].replace(" hm,", ""))
        assert plain in (text, text + ".")

    def number(*parts: str) -> float:
        return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:8], 16) / 2.0**32

    # the first sentence of each, by the rule: prefix 0.25, mid 0.4 a comma, suffix 0.55
    led = 0
    for i in range(60):
        said = "one, two, three, four."
        lead = number(str(i), "3|prefix", "0", "p") < 0.5
        clauses = (("So, well, " if lead else "") + said).split(",")
        clauses = [f" hm,{c}" if k and number(str(i), "3|mid", "0", str(k), "p") < 2.0 else c for k, c in enumerate(clauses)]
        want = ",".join(clauses)
        want = want[:-1] + ", eh." if number(str(i), "3|suffix", "0", "p") < 1.1 else want
        assert got[i].startswith(want + " ")
        led += lead
    assert 10 < led < 50
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "_c#" not in plan


def test_picks_follow_the_weights(spark):
    """Every draw gets the term whose running weight first reaches it, in pools of any size."""
    rng = random.Random(8)
    rows = [("big", f"t{i}", rng.choice([0.001, 0.5, 3.0, 0.0])) for i in range(900)] + [("one", "only", 0.2), ("none", "never", 0.0)]
    intervals = ops.pool_intervals(spark.createDataFrame(rows, "slot string, term string, weight double"))
    own = sorted((r.upto, r.share, r.term) for r in intervals.where("slot = 'big'").collect())
    total = own[-1][0]
    assert total == sum(round(w * 1e9) for s, _, w in rows if s == "big") and all(b[0] - b[1] == a[0] for a, b in zip(own, own[1:]))
    us = [0.0, *(rng.random() for _ in range(2000)), 1.0 - 2.0**-32]
    draws = spark.createDataFrame([(s, u) for s in ("big", "one", "none", None) for u in us], "slot string, u double")
    got = ops.weighted_pick(draws, intervals, "term").collect()
    assert len(got) == 4 * len(us)
    for r in got:
        want = next(t for upto, _, t in own if r.u * total <= upto) if r.slot == "big" else "only" if r.slot == "one" else None
        assert r.term == want


def test_persona_and_arc(spark):
    df = spark.createDataFrame([("sidorovich", 1.0, 1.0, 1.0), ("other", 0.2, 0.3, 0.4)], "persona string, arousal double, dominance double, valence double")
    got = {r.persona: (r.arousal, r.dominance, r.valence) for r in ops.persona_reaction(df).collect()}
    assert got["sidorovich"] == pytest.approx((0.45, 0.65, 0.05)) and got["other"] == pytest.approx((0.2, 0.3, 0.4))


def test_joins_with_transcripts(spark):
    clips = spark.createDataFrame([("a.wav",), ("orphan.wav",), ("blank.wav",)], "clip string")
    texts = spark.createDataFrame([("a.wav", "hi"), ("blank.wav", "")], "clip string, text string")
    assert [r.clip for r in ops.label_clips(clips, texts).collect()] == ["a.wav"]
    assert {r.clip for r in ops.unlabelled_clips(clips, texts).collect()} == {"orphan.wav", "blank.wav"}
    assert ops.label_clips(clips, texts.limit(0)).count() == 0


def test_word_distance_for_stretches_of_any_size():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert {distance(a, b, bits) for bits in (1, 3, 4096)} == {row[-1]}
    long = [str(rng.randrange(3000)) for _ in range(20_000)]
    assert distance(long, [w for i, w in enumerate(long) if i % 4000]) == 5


def test_default_glossary_in_one_pass_equals_rule_by_rule(one):
    texts = [
        "pull  request pulls pulled code review reviewed CODE REVIEWS git-Git gitGit",
        "Commitſ Kubernetes k8s commit_ precommit commits. logsſ bugſfix",
        "pull\nrequests, pull requestx pulling request code review",
        "",
    ]
    for text in texts:
        assert one(tr.apply_glossary, text) == one(lambda c: tr.rewrite(c, tr.GLOSSARY, "iuU"), text)
    assert tr._GLOSSARY_WORD and all(p.startswith(r"\b") for p, _ in tr.GLOSSARY)


def test_marks_are_needed_by_their_rules(one):
    text = "***a*** **b** _c_ __d__ ___e___\n| a | b |\n|---|\n> q\n---\n# t\n\n\n\n/cmd x\\n \\\n - b\n![i](u)[l](u) `c` ```x``` <think>z</think> /no_think \n /clear \nz"
    plain = lambda c, rules: __import__("functools").reduce(lambda s, r: F.regexp_replace(s, f"(?dU){r[0]}", r[1]), rules, c)
    rules = tr.MODEL_ARTEFACTS + tr.MARKDOWN_BEFORE_ROWS + tr.MARKDOWN_AFTER_ROWS
    assert set(tr.RULE_MARKS) >= {p for p, _ in rules if "`" in p or "*" in p.replace(".*", "").replace("]*", "").replace("s*", "") and "p{L}" not in p}
    for part in [text, *text.split("\n"), "- a", "no marks", "+ a", "* a"]:
        assert one(lambda c: tr.rewrite(c, rules), part) == one(lambda c: plain(c, rules), part)


def test_strokes_of_odd_ends(one):
    got = one(tr.strokes, " a..b...c....d,,;é—f x…y！z")
    assert [(s["text"], s["delimiter"]) for s in got] == [
        ("a", "ellipsis"), ("b", "ellipsis"), ("c", "ellipsis"), ("d", "comma"), ("é", "dash"), ("f x", "ellipsis"), ("y", "exclamation"), ("z", "end"),
    ]


def test_numbers_and_strip_look_cheaply(one):
    assert one(tr.strip, "\u0085  a b　\n") == "a b" and one(tr.strip, " " * 200_000 + "a" + " " * 200_000 + "b") == "a" + " " * 200_000 + "b"
    assert tr._NUMBER.startswith("(?=[-0-9])")


def test_log_rules_are_tested_once_a_line(spark):
    plan = spark.range(1).select(tr.log_event(F.col("id").cast("string")).alias("e"))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.upper().count("RLIKE") <= sum(kind == "re" for _, kind, *_ in tr.LOG_RULES)
