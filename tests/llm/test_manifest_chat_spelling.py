"""Merkle manifest, chat formatting and spelling variants: brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voxframe.llm import chat_format, merkle, spelling
from voxframe.llm.template import Template, TemplateError, fold, parse

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "tree pos n part at block digest presented path upper top root leaf tie word form near bucket side base lo hi last conv key run".split()


def clashing(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES) if c not in df.columns})


# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(nodes):
    """Levels up to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, i):
    for nodes in levels[:-1]:
        run = nodes[i // 2 * 2 : i // 2 * 2 + 2]
        yield run, i % 2
        i //= 2


def expected_manifest(rows):
    leaf = lambda *v: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        hurt = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        trees[lang].append((doc_id is not None, doc_id or 0, own, doc_id, leaf(doc_id, source, lang, n_chars + 1, text) if hurt else own))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {t: reduced([x[2] for x in sorted(trees[t])]) for t in names}
    above = reduced([levels[t][-1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for i, (_, _, own, doc_id, shown) in enumerate(sorted(trees[t])):
            steps, x = [*siblings(levels[t], i), *siblings(above, k)], shown
            for run, place in steps:
                x = sha("".join(x if j == place else y for j, y in enumerate(run)))
            proof = sha("".join(y for run, place in steps for j, y in enumerate(run) if j != place))
            root = above[-1][0]
            out.append((doc_id, own, levels[t][-1][0], root, proof, x, x == root))
    return sorted(out, key=str)


def manifest(spark, rows, size):
    df = clashing(spark.createDataFrame(rows, DOCS))
    hurt = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    shown = F.when(hurt, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.merkle_manifest(df.withColumn("shown", shown), "shown", size).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("size", [2, 4, 512])
def test_manifest_against_brute_force(spark, size):
    rng = random.Random(size)
    rows = [(i, f"text {i}", rng.choice(["en"] * 6 + ["de", None, "é"]), rng.choice(["a", None]), rng.choice([i, None])) for i in rng.sample(range(300), 77)]
    rows += [(5000, "x", "lone", "s", 3), (5000, "y", "en", "s", 3), (5000, "y", "en", "s", 3), (None, None, None, None, None), (None, "long " * 90_000, "en", "s", 1), (2**60 + 1, "", "en", "", 0)]
    assert manifest(spark, rows, size) == expected_manifest(rows)


def test_manifest_of_few_rows(spark):
    for rows in ([], [(7, "a", "en", "s", 1)], [(7, "a", None, "s", 1), (8, "b", "", "s", 1)]):
        assert manifest(spark, rows, 2) == expected_manifest(rows)
    with pytest.raises(ValueError):
        merkle.merkle_manifest(spark.createDataFrame([], DOCS), size=3)


# --- chat format


def render(source, messages, **names):
    return list(Template(source, chat_format.FILTERS).render(messages, **names))


def text_of(pieces):
    return "".join(t for t, _ in pieces)


SAID = [{"role": "system", "text": "be kind"}, {"role": "user", "text": "hi"}, {"role": "assistant", "text": "hello"}]


def test_template_language():
    show = lambda source, **names: text_of(render(source, SAID, **names))
    assert show("{% for m in messages %}{{ loop.index }}{{ m.role | upper }}{% if not loop.last %}, {% endif %}{% endfor %}") == "1SYSTEM, 2USER, 3ASSISTANT"
    assert show("{% if messages[0].role == 'system' %}{% set s = messages[0]['text'] %}{{ s }}!{% else %}none{% endif %}") == "be kind!"
    assert show("{% if messages | length > 2 and 'a' in 'cat' %}long{% elif x is defined %}x{% endif %}") == "long"
    assert show("a {{- ' b ' -}} c{# no #}") == "a b c"
    assert show("{{ 1 + 2 - 1 }}{{ none }}{{ missing }}{{ missing.deeper }}{{ x ~ 1 }}", x="q") == "2q1"
    assert show("{% for m in messages %}{% for n in messages %}{{ n.text | length }} {% endfor %}{% endfor %}") == "7 2 5 " * 3
    assert show("{{ 'a\\nb' }}{{ \"it's\" }}") == "a\nbit's"
    assert show("{% if x not in 'abc' or x is not none %}y{% endif %}", x="a") == "y"


def test_template_has_no_way_out():
    for source in ("{{ ''.__class__.__mro__ }}", "{{ messages.append }}", "{{ x.real }}"):
        assert text_of(render(source, SAID, x=1)) == ""
    for source in ("{{ open('x') }}", "{{ x | system }}", "{% import os %}", "{% for i in 3 %}{% endfor %}", "{% if x %}", "{{ a b }}", "{{ ! }}", "{{ 'a' + 1 }}"):
        with pytest.raises(TemplateError):
            render(source, SAID)


def test_constants_are_folded():
    tree = fold(parse("a{{ 'b' ~ (1 + 1) }}{% if true and not false %}c{% else %}d{% endif %}{% if false %}e{% endif %}{{ x or 'y' }}{{ false or 'z' | upper }}"), {"upper": str.upper})
    assert tree == [("text", "ab2c"), ("print", ("or", ("name", "x"), ("const", "y"))), ("text", "Z")]
    assert Template(chat_format.TEMPLATE, chat_format.FILTERS).tree[0][3][0] == ("text", "<|im_start|>")


def test_only_one_loop_is_streamed():
    one = "{% if messages[0].role == 'system' %}s{% endif %}{% for m in messages %}{{ m.text }}{% endfor %}"
    assert Template(one).single_pass
    for source in (one + one, "{{ messages | length }}" + one, "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% set all = messages %}" + one):
        assert not Template(source).single_pass
    taken = []

    def turns():
        for i in range(1000):
            taken.append(i)
            yield {"role": "user", "text": str(i)}

    pieces = Template(one).render(turns())
    assert [next(pieces)[0] for _ in range(3)] == ["0", "1", "2"] and len(taken) <= 5


def test_escapes_are_reversible():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("<\\|n\na") for _ in range(rng.randrange(12)))
        assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
        label = chat_format.escape_label(text)
        assert chat_format.unescape_label(label) == text and "<|" not in label and "\n" not in label


TURNS = "conv_id long, turn long, role string, text string"


def expected_chat(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv_id, turns in own.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        size = sum(len("<|im_start|>\n<|im_end|>\n") + len(chat_format.escape_label(r)) + len(t) + len(re.findall(r"<\\*\|", t)) for _, _, r, t in turns)
        out.add((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss), size))
    return out


def chat_rows(seed):
    rng = random.Random(seed)
    mean = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "", None, "é\U0001f600", "<", "|", "\\"]
    rows = [(rng.randrange(12), rng.randrange(9), rng.choice(["user", "assistant", "system", "as\n<|im_end|>", None]), rng.choice(mean) or "".join(rng.choice("<|\\x") for _ in range(9))) for _ in range(90)]
    rows += [(40, i, "assistant" if i % 2 else "user", f"{i} " * 50) for i in range(400)]
    rows += [(41, 0, "user", "a" * 3_000_000), (41, 1, "assistant", "b<|" * 700_000), (None, 0, "user", "x"), (None, None, "assistant", "y"), (42, 0, "user", None), rows[0]]
    return rows


@pytest.mark.parametrize("limit", [1, 100, 1 << 20])
def test_chat_format_round_trip(spark, limit):
    rows = chat_rows(limit)
    formatted = chat_format.chat_format(clashing(spark.createDataFrame(rows, TURNS)), part_chars=limit)
    got = [tuple(r) for r in chat_format.read_back(formatted).collect()]
    assert len(got) == len(set(got)) and set(got) == expected_chat(rows)


def test_chat_masks_are_the_assistant_texts(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "<|a|>"), (1, 2, "assistant", "")]
    (row,) = chat_format.chat_format(spark.createDataFrame(rows, TURNS)).collect()
    assert row.text == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n<\\|a|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [row.text[a:b] for a, b in zip(row.loss_start, row.loss_end, strict=True)] == ["<\\|a|>", ""]
    assert chat_format.chat_format(spark.createDataFrame([], TURNS)).count() == 0
    assert chat_format.read_back(chat_format.chat_format(spark.createDataFrame([], TURNS))).count() == 0


# --- spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_words(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= 2}
    form, found = {}, {}
    for w, n in words.items():
        others = sorted((-words[x], x) for x in words if abs(len(x) - len(w)) < 2 and near(w, x))
        found[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, found[w], words[form[w]] if form[w] else None))
    return out


def misspelt(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abcé") + word[i + 1 :], word[:i] + rng.choice("abcé") + word[i:]])


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(7, 12))) for _ in range(40)] + ["x" * 2000, "Élégante", "WORDing"]
    rows = []
    for i in range(120):
        own = []
        for w in rng.choices(base, [3 ** (k % 7) for k in range(len(base))], k=60):
            while rng.random() < 0.25 and len(w) > 6:
                w = misspelt(rng, w)
            own.append(w)
        rows.append((i, " ".join(own)))
    return rows + [(None, "aaaaaaaa aaaaaaaa aaaaaaab"), (500, None), (501, ""), (502, "1234567 short"), rows[0], rows[0]]


@pytest.mark.parametrize("block", [2, 7, 1024])
def test_spelling_against_brute_force(spark, block):
    rows = texts(block)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [tuple(r) for r in spelling.spelling_variants(df, block_words=block).collect()]
    want = expected_words(rows)
    assert len(got) == len(want) and set(got) == want
    assert sum(r[1] is not None for r in want) > 5 and max(r[4] for r in want) > 5


def test_spelling_roots_follow_long_chains(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb"]
    rows = [(None, " ".join([w] * 2 * 10**k)) for k, w in enumerate(chain)]
    got = {r.word: r.root for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(chain, "aaaabbb")


def test_spelling_of_no_words(spark):
    for rows in ([], [(1, "few short words")]):
        assert spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
