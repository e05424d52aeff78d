"""Fixed text rules: patterns, word lists and the expressions that apply them.

Patterns run in Java's Unicode mode (U), with LF as the only line end (d) where
lines matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxframe.functions.scalar import let

# Markdown rewrites up to the table rows, in order.
MARKDOWN_BEFORE_ROWS = [
    (r"(?s)\n?```.*?```\n?", "\n"),
    (r"(?s)```.*", ""),
    (r"`[^`]+`", ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*{3}(.+?)\*{3}", "$1"),
    (r"\*{2}(.+?)\*{2}", "$1"),
    (r"\*(.+?)\*", "$1"),
    (r"_{3}(.+?)_{3}", "$1"),
    (r"_{2}(.+?)_{2}", "$1"),
    (r"_(.+?)_", "$1"),
    (r"(?m)^>\s*", ""),
    (r"(?m)^[-*_]{3,}\s*$", ""),
    (r"(?m)^[─-▟\s]{2,}$", ""),
    (r"[─-▟]+", " "),
    (r"(?m)^\|[-:\s|]+\|\s*$", ""),
]
# A table row; its cells stay, its pipes become spaces.
MARKDOWN_ROW = r"(?m)^\|(.+)\|\s*$"
# Markdown rewrites after the table rows, in order.
MARKDOWN_AFTER_ROWS = [
    (r"(?m)^[^\p{L}\p{N}\n]*$", ""),
    (r"(?m)^[\s]*[-*+]\s+", ""),
    (r"(?m)^[\s]*\d+\.\s+", ""),
    (r"\\[|ntrfv\\]", " "),
    (r"(?m)\\\s*$", ""),
    (r"(?i)(?:^|\s)/[a-z][a-z0-9_-]*", ""),
    (r"\n{3,}", "\n\n"),
]

# Model artefacts removed from replies, in order.
MODEL_ARTEFACTS = [
    (r"(?s)<think>.*?</think>", ""),
    (r"(?i)/(no_think|think|system|inst)[^\s]*", ""),
    (r"(?m)^\s*[/\\][a-z_]+\s*$", ""),
]

# What a text must hold, one of these, for a rule above to match at all; rules that are not named may match any text.
RULE_MARKS = {
    r"(?s)\n?```.*?```\n?": ["```"],
    r"(?s)```.*": ["```"],
    r"`[^`]+`": ["`"],
    r"!\[[^\]]*\]\([^)]*\)": ["]("],
    r"\[([^\]]+)\]\([^)]*\)": ["]("],
    r"(?m)^#{1,6}\s+": ["#"],
    r"\*{3}(.+?)\*{3}": ["***"],
    r"\*{2}(.+?)\*{2}": ["**"],
    r"\*(.+?)\*": ["*"],
    r"_{3}(.+?)_{3}": ["___"],
    r"_{2}(.+?)_{2}": ["__"],
    r"_(.+?)_": ["_"],
    r"(?m)^>\s*": [">"],
    r"(?m)^[-*_]{3,}\s*$": ["-", "*", "_"],
    r"(?m)^\|[-:\s|]+\|\s*$": ["|"],
    MARKDOWN_ROW: ["|"],
    r"(?m)^[\s]*[-*+]\s+": ["-", "*", "+"],
    r"\\[|ntrfv\\]": ["\\"],
    r"(?m)\\\s*$": ["\\"],
    r"(?i)(?:^|\s)/[a-z][a-z0-9_-]*": ["/"],
    r"\n{3,}": ["\n\n\n"],
    r"(?s)<think>.*?</think>": ["<think>"],
    r"(?i)/(no_think|think|system|inst)[^\s]*": ["/"],
    r"(?m)^\s*[/\\][a-z_]+\s*$": ["/", "\\"],
}

# Cardinal words.
HUNDREDS = ["", "сто", "двести", "триста", "четыреста", "пятьсот", "шестьсот", "семьсот", "восемьсот", "девятьсот"]
TEENS = [
    "десять", "одиннадцать", "двенадцать", "тринадцать", "четырнадцать",
    "пятнадцать", "шестнадцать", "семнадцать", "восемнадцать", "девятнадцать",
]
TENS = ["", "", "двадцать", "тридцать", "сорок", "пятьдесят", "шестьдесят", "семьдесят", "восемьдесят", "девяносто"]
ONES_MASCULINE = ["", "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять"]
ONES_FEMININE = ["", "одна", "две", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять"]
THOUSAND_FORMS = ("тысяча", "тысячи", "тысяч")
MILLION_FORMS = ("миллион", "миллиона", "миллионов")
MILLIARD_FORMS = ("миллиард", "миллиарда", "миллиардов")
TRILLION_FORMS = ("триллион", "триллиона", "триллионов")
QUADRILLION_FORMS = ("квадриллион", "квадриллиона", "квадриллионов")
QUINTILLION_FORMS = ("квинтиллион", "квинтиллиона", "квинтиллионов")
ZERO_WORD = "ноль"
MINUS_WORD = "минус"
PERCENT_WORD = "процентов"

# Emotion signals as (class, weight, name, pattern), in rule order.
# A pattern of None marks the rules that need more than one match (see below).
EMOTION_RULES = [
    ("angry", 2, "caps-lock", None),
    ("angry", 1, "double-exclamation", None),
    ("angry", 2, "aggressive-en-words", r"\b(wtf|fuck|shit|damn|idiot|stupid|useless|broken|crap|hell)\b"),
    ("angry", 2, "aggressive-ru-words", r"(идиот|тупой|сломал|бесполезн|дурак|чёрт|чёрт возьми)"),
    ("angry", 1, "short-aggressive", None),
    ("frustrated", 2, "ellipsis", r"\.{3,}"),
    ("frustrated", 2, "frustration-en-words", r"\b(ugh|argh|sigh|again|still|always|never|every time|seriously|how many)\b"),
    ("frustrated", 2, "frustration-ru-words", r"(опять|снова|всегда|никогда|серьёзно|сколько раз|ну сколько)"),
    ("frustrated", 1, "double-question", r"[?]{2,}"),
    ("frustrated", 1, "why-question", r"(why|почему|зачем).{0,30}[?!]"),
    ("sarcastic", 3, "sarcasm-en-markers", r"\b(oh great|oh sure|just perfect|wonderful|brilliant|just what i needed|love it|fantastic)\b"),
    ("sarcastic", 3, "sarcasm-ru-markers", r"(ну конечно|само собой|ещё бы|надо же|вот уж|неудивительно)"),
    ("sarcastic", 1, "irony-adverbs", r"\b(obviously|clearly|of course|totally|definitely|naturally)\b"),
    ("sarcastic", 2, "backhanded-compliment", r"\b(thanks for nothing|great job|well done|nice work)\b"),
    ("excited", 2, "triple-exclamation", r"[!]{3,}"),
    ("excited", 2, "excited-en-words", r"\b(amazing|awesome|incredible|genius|perfect|exactly|love this|this is it)\b"),
    ("excited", 2, "excited-ru-words", r"(отлично|шикарно|гениально|невероятно|обалдеть|класс|круто)"),
    ("excited", 3, "excitement-emoji", r"[🔥💯🎉✨🚀😍🤯⚡]"),
    ("excited", 1, "excited-en-interjections", r"\b(omg|omfg|holy shit|no way|wow)\b"),
    ("cute", 3, "over-polite-en", r"\b(please|kindly|would you mind|could you possibly|pretty please|if you don't mind|sorry to bother)\b"),
    ("cute", 3, "over-polite-ru", r"(пожалуйста|не могли бы вы|будьте добры|извините что беспокою|спасибо большое)"),
    ("cute", 4, "uwu-energy", r"\b(uwu|owo|hehe|teehee|heehee)\b"),
    ("cute", 2, "cute-emoji", "[💕💖💗💓💞❤️🥺👉👈😊🙏🫶]"),
    ("cute", 2, "excessive-flattery", r"\b(you're amazing|you're the best|you're so smart|so helpful)\b"),
    ("cute", 1, "tilde-suffix", r"~"),
]
EMOTION_CLASSES = ["angry", "frustrated", "sarcastic", "excited", "cute"]

# Technical words that raise the prefix score.
TECH_WORDS = r"(баг|деплой|пайплайн|коммит|API|HTTP|сервер|лог|тест|билд|фича|фикс|кэш|бэкенд|фронтенд)"

# Default glossary as ordered (pattern, replacement).
GLOSSARY = [
    (r"\bpull\s+request(s)?\b", "пуллреквест"),
    (r"\bcommit(s|ted|ting)?\b", "коммит"),
    (r"\bmerge(d|ing)?\b", "мерж"),
    (r"\brebase(d|ing)?\b", "ребейс"),
    (r"\bcheckout\b", "чекаут"),
    (r"\bstash\b", "стеш"),
    (r"\bpush(ed|ing)?\b", "пуш"),
    (r"\bpull(ed|ing)?\b", "пулл"),
    (r"\bfork(ed|ing)?\b", "форк"),
    (r"\bbranch(es)?\b", "ветка"),
    (r"\b[Gg]it\b", "гит"),
    (r"\bdeploy(ment|ed|ing|s)?\b", "деплой"),
    (r"\brollback\b", "роллбек"),
    (r"\bpipeline(s)?\b", "пайплайн"),
    (r"\bstaging\b", "стейджинг"),
    (r"\bprod(uction)?\b", "прод"),
    (r"\bcontainer(s)?\b", "контейнер"),
    (r"\b[Dd]ocker\b", "докер"),
    (r"\b[Kk]ubernetes\b", "кубернетес"),
    (r"\bk8s\b", "кубернетес"),
    (r"\bdebug(ging|ged)?\b", "дебаг"),
    (r"\brefactor(ing|ed)?\b", "рефактор"),
    (r"\bbuild(ing|s)?\b", "билд"),
    (r"\btest(s|ing|ed)?\b", "тест"),
    (r"\bfeature(s)?\b", "фича"),
    (r"\bbug(s|fix)?\b", "баг"),
    (r"\bfix(ed|ing|es)?\b", "фикс"),
    (r"\bcache\b", "кэш"),
    (r"\blog(s|ging)?\b", "лог"),
    (r"\bbackend\b", "бэкенд"),
    (r"\bfrontend\b", "фронтенд"),
    (r"\bserver(s)?\b", "сервер"),
    (r"\bdatabase\b", "база данных"),
    (r"\brelease(s|d)?\b", "релиз"),
    (r"\bcode\s+review\b", "ревью"),
    (r"\breview(ed|ing|s)?\b", "ревью"),
    (r"\bsprint(s)?\b", "спринт"),
    (r"\bstandup\b", "стендап"),
    (r"\bticket(s)?\b", "тикет"),
]

# Stroke delimiters by name.
DELIMITERS = {
    ".": "period",
    "..": "ellipsis",
    "...": "ellipsis",
    "…": "ellipsis",
    "!": "exclamation",
    "！": "exclamation",
    "?": "question",
    "？": "question",
    ",": "comma",
    "，": "comma",
    ";": "semicolon",
    ":": "colon",
    "—": "dash",
    "–": "dash",
    "\n": "newline",
    "": "end",
}
STROKE = r"([^.!！?？,，;:—–\n…]*)(\.{2,3}|[.!！?？,，;:—–\n…]|\z)"

# Half-lives, floor and steps of the decaying emotion state.
HALF_LIFE_MS = 300_000.0
FAST_HALF_LIFE_MS = 60_000.0
INTENSITY_FLOOR = 0.1
SAME_EMOTION_GAIN = 0.35
OVERRULED_FACTOR = 0.6

# Peak weights per emotion: (mat, interject, heat_min, word_bias).
PEAK_WEIGHTS = {
    "angry": (2.0, 0.5, 3, "aggressive"),
    "frustrated": (1.5, 1.0, 2, "commiseration"),
    "sarcastic": (0.8, 2.0, 1, "mockery"),
    "excited": (0.3, 3.0, 1, "excitement"),
    "cute": (1.5, 2.5, 1, "mockery"),
    "neutral": (1.0, 1.0, 1, "neutral"),
}

# Training-log rules in order: (event, kind, test, captures).
# kind "has": all substrings occur; "re": the pattern matches, groups are captured;
# "after": the substring occurs, the capture is what follows the last separator.
LOG_RULES = [
    ("checkpoint_cached", "after", "already cached at", ("path", "at ")),
    ("checkpoint_downloading", "has", ("downloading", "HuggingFace"), ()),
    ("dataset_ready", "re", r"\[train\] (\d+) WAV files", ("wav_files",)),
    ("dataset_ready", "re", r"\[train\] (\d+) files with transcripts", ("transcripts",)),
    ("vq_started", "has", ("[train] extracting semantic tokens",), ()),
    ("vq_progress", "re", r"Processed (\d+)/(\d+) files.*?(\d+\.\d+) hours", ("files", "total", "hours")),
    ("vq_complete", "re", r"Finished processing (\d+) files.*?(\d+\.\d+) hours", ("files", "hours")),
    ("dataset_built", "re", r"Finished writing (\d+) shards", ("shards",)),
    ("training_started", "re", r"\[train\] fine-tuning (\d+) steps", ("steps",)),
    ("model_loading", "after", "Loading model from", ("params", "config: ")),
    ("model_loaded", "re", r"(\d+[\.\d]*\s*[MBK])\s+Trainable.*?(\d+[\.\d]*\s*[MBG])\s+Total params", ("trainable", "total_params")),
    ("sanity_check", "has", ("Sanity Checking",), ()),
    ("training_step", "re", r"step[= ](\d+).*?loss[= ]([\d.]+)", ("step", "loss")),
    ("training_complete", "re", r"\[train\] training done in (\d+)s", ("elapsed_secs",)),
    ("merging_lora", "after", "[train] merging LoRA", ("checkpoint", ": ")),
    ("model_saved", "after", "[train] model saved", ("path", "to ")),
    ("done", "has", ("[train] DONE",), ()),
]
LOG_OOM = ["CUDA out of memory", "OutOfMemoryError"]
LOG_ERRORS = ["CalledProcessError", "RuntimeError", "Error executing job", "crash-looping"]
LOG_NOISE = ["SyntaxWarning", "FutureWarning", "UserWarning", "deprecat"]
LOG_NOISE_PREFIXES = ["[1A", "  "]
LOG_INT_FIELDS = ["wav_files", "transcripts", "files", "total", "shards", "steps", "step", "elapsed_secs"]
LOG_FLOAT_FIELDS = ["hours", "loss"]
LOG_TEXT_FIELDS = ["path", "params", "trainable", "total_params", "checkpoint"]
# Progress line and terminal states of a followed job.
PROGRESS = r"(\d+)/(\d+)\s*\[.*?loss=([\d.]+).*?accuracy=([\d.]+)"
FAILED_MARKS = ["CalledProcessError", "CUDA out of memory", "crash-looping"]


def rewrite(text: Column, rules: Sequence[tuple[str, str]], flags: str = "dU") -> Column:
    """Apply ordered regex replacements, each on the result of the one before.

    A rule whose marks are known is skipped for a text that holds none of them.
    """

    def apply(s: Column, rule: tuple[str, str]) -> Column:
        replaced = lambda x: F.regexp_replace(x, f"(?{flags}){rule[0]}", rule[1])
        if rule[0] not in RULE_MARKS:
            return replaced(s)
        marked = lambda x: reduce(lambda a, b: a | b, [x.contains(m) for m in RULE_MARKS[rule[0]]])
        return let(s, lambda x: F.when(marked(x), replaced(x)).otherwise(x))

    return reduce(apply, rules, text)


#: Unicode white space, as the patterns' ``\\s`` has it.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(text, F.lit(WHITE))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _word(options: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), index.cast("int") + 1)


def _below_thousand(n: Column, feminine: bool) -> Column:
    rest = n % 100
    teen = (rest >= 10) & (rest <= 19)
    ones = ONES_FEMININE if feminine else ONES_MASCULINE
    parts = F.array(
        _word(HUNDREDS, F.floor(n / 100)),
        F.when(teen, _word(TEENS, F.greatest(rest - 10, F.lit(0)) % 10)).otherwise(_word(TENS, F.floor(rest / 10))),
        F.when(teen, F.lit("")).otherwise(_word(ones, rest % 10)),
    )
    return F.array_join(F.filter(parts, lambda w: w != ""), " ")


def _plural(n: Column, forms: tuple[str, str, str]) -> Column:
    one, few, many = forms
    return (
        F.when((n % 100).between(11, 19), many).when(n % 10 == 1, one).when((n % 10).between(2, 4), few).otherwise(many)
    )


def number_words(n: Column) -> Column:
    """Cardinal words of any 64-bit integer."""
    # groups of three digits, cut from the digits as text: the smallest integer has no positive counterpart
    digits = F.lpad(F.translate(n.cast("string"), "-", ""), 21, "0")
    group = lambda i: F.substring(digits, 3 * i + 1, 3).cast("int")
    forms = (QUINTILLION_FORMS, QUADRILLION_FORMS, TRILLION_FORMS, MILLIARD_FORMS, MILLION_FORMS, THOUSAND_FORMS)
    parts = [F.when(n < 0, MINUS_WORD), F.when(n == 0, ZERO_WORD)]
    for i, names in enumerate(forms):
        said = F.concat_ws(" ", _below_thousand(group(i), names is THOUSAND_FORMS), _plural(group(i), names))
        parts.append(F.when(group(i) > 0, said))
    parts.append(F.when(group(6) > 0, _below_thousand(group(6), False)))
    return F.when(n.isNotNull(), F.array_join(F.array(*parts), " "))


# a standalone integer: not glued to a letter or dot before, nor to a letter, dot
# or underscore after; a following percent sign belongs to it. It begins with a sign
# or digit, which is looked at first
_NUMBER = r"(?=[-0-9])(?:(?<![\p{IsAlphabetic}.])-|(?<![\p{IsAlphabetic}.0-9-]))[0-9]++(?![.\p{IsAlphabetic}_])%?"


def normalise_numbers(text: Column) -> Column:
    """Standalone integers as words; other numbers stay as they are."""

    def spoken(token: Column) -> Column:
        digits = F.regexp_replace(token, "%", "")
        said = number_words(digits.try_cast("bigint"))
        percent = F.when(token.endswith("%"), F.lit(" " + PERCENT_WORD)).otherwise("")
        return F.when(said.isNull(), token).otherwise(F.concat(said, percent))

    around = F.split(text, _NUMBER, -1)
    numbers = F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0))
    return F.array_join(
        F.zip_with(around, numbers, lambda piece, n: F.concat(piece, F.coalesce(spoken(n), F.lit("")))), ""
    )


_OPEN, _CLOSE = "", ""
_ROW_PIPE, _ROW_OPEN, _ROW_CLOSE = rf"\|(?=[^{_OPEN}{_CLOSE}\n]*{_CLOSE})", rf"{_OPEN}[^\S\n]*", rf"[^\S\n]*{_CLOSE}"
RULE_MARKS |= {_ROW_PIPE: [_CLOSE], _ROW_OPEN: [_OPEN], _ROW_CLOSE: [_CLOSE]}


def strip_markdown(text: Column, numbers: bool = True) -> Column:
    s = rewrite(text, MARKDOWN_BEFORE_ROWS)
    # rows are fenced with private-use marks so their pipes can be told apart
    s = rewrite(
        s,
        [
            (MARKDOWN_ROW, f"{_OPEN}$1{_CLOSE}"),
            (_ROW_PIPE, " "),
            (_ROW_OPEN, ""),
            (_ROW_CLOSE, ""),
        ],
    )
    s = rewrite(s, MARKDOWN_AFTER_ROWS)
    return strip(normalise_numbers(s) if numbers else s)


def scrub_artefacts(text: Column) -> Column:
    return strip(rewrite(text, MODEL_ARTEFACTS))


def remove_code(text: Column) -> Column:
    """Text outside code, with back-tick runs as toggles.

    A run of three or more opens or closes a block; one or two open or close
    inline code unless a block is open.
    """
    between = F.split(text, "`+", -1)
    marks = F.regexp_extract_all(text, F.lit("`+"), F.lit(0))
    after = F.zip_with(
        F.slice(between, 2, F.size(between)), marks, lambda seg, run: F.struct(seg.alias("seg"), F.length(run).alias("n"))
    )
    start = F.struct(
        F.lit(False).alias("block"), F.lit(False).alias("inline"), F.slice(between, 1, 1).alias("kept")
    )

    def toggle(state: Column, part: Column) -> Column:
        block = F.when(part["n"] >= 3, ~state["block"]).otherwise(state["block"])
        inline = F.when((part["n"] < 3) & ~state["block"], ~state["inline"]).otherwise(state["inline"])
        seg = F.when(block | inline, "").otherwise(part["seg"])
        return F.struct(block.alias("block"), inline.alias("inline"), F.concat(state["kept"], F.array(seg)).alias("kept"))

    return F.aggregate(after, start, toggle, lambda state: F.array_join(state["kept"], ""))


# any default glossary rule: each begins at a word's border and with one of these letters, two of which
# have a further form of the same case (K, ſ); both are looked at first, as most places fail there
_GLOSSARY_WORD = (
    r"(?=[bcdfgklmprstBCDFGKLMPRST\x{212A}\x{17F}])(?<![a-zA-Z0-9_])(?iuU:\b(?:" + "|".join(pattern.removeprefix(r"\b") for pattern, _ in GLOSSARY) + "))"
)


def apply_glossary(text: Column, glossary: Sequence[tuple[str, str]] = GLOSSARY) -> Column:
    """Terms of a glossary replaced, rule by rule.

    Default rules match whole words, and none matches what another one wrote or a part of two
    others' words. So the words are found in one pass, and the rules go over those alone.
    """
    if glossary is not GLOSSARY:
        return rewrite(text, glossary, flags="iuU")
    around = F.split(text, _GLOSSARY_WORD, -1)
    found = F.regexp_extract_all(text, F.lit(_GLOSSARY_WORD), F.lit(0))
    said = lambda piece, word: F.concat(piece, F.coalesce(rewrite(word, glossary, flags="iuU"), F.lit("")))
    return F.array_join(F.zip_with(around, found, said), "")


CUT = r"(?U)\n\n+|(?<=[.!?])\s+"


def pieces(text: Column, max_cuts: int | None = None) -> Column:
    """Text cut at blank lines and sentence ends; the last piece is the remainder."""
    return F.split(text, CUT, -1 if max_cuts is None else max_cuts + 1)


def chunks(text: Column, max_cuts: int | None = None) -> Column:
    """Complete chunks longer than two bytes."""
    cut = pieces(text, max_cuts)
    done = F.transform(F.slice(cut, 1, F.size(cut) - 1), strip)
    return F.filter(done, lambda c: F.octet_length(c) > 2)


def remainder(text: Column, max_cuts: int | None = None) -> Column:
    return F.element_at(pieces(text, max_cuts), -1)


def all_chunks(text: Column) -> Column:
    """Chunks of a finished message, the flushed remainder included."""
    return F.filter(F.transform(pieces(text, None), strip), lambda c: F.octet_length(c) > 2)


def sentences(text: Column) -> Column:
    """Sentences with their punctuation; the whole text if there is no cut."""
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+", -1), lambda s: s != "")


# plain characters first, by a class that is quicker to test
_WHOLE_STROKE = r"[a-zA-Z0-9 ]*" + STROKE


def strokes(text: Column) -> Column:
    """Clauses as array<struct<text, delimiter>>; empty ones are dropped."""
    names = F.create_map(*[F.lit(x) for kv in DELIMITERS.items() for x in kv])
    edge = F.lit(WHITE + "".join(sorted(d for d in DELIMITERS if len(d) == 1)))
    # a body holds no delimiter, so the last characters tell which one ended it
    ending = lambda m: F.when(m.endswith(".."), "ellipsis").otherwise(F.coalesce(F.try_element_at(names, F.right(m, F.lit(1))), F.lit("end")))
    pairs = F.transform(
        F.regexp_extract_all(text, F.lit(_WHOLE_STROKE), F.lit(0)),
        lambda m: F.struct(F.btrim(m, edge).alias("text"), ending(m).alias("delimiter")),
    )
    return F.filter(pairs, lambda p: p["text"] != "")


def caps_words(tokens: Column) -> Column:
    """Tokens of three bytes or more without a lower-case letter but with an upper-case one."""
    return F.filter(
        tokens,
        lambda w: (F.octet_length(w) >= 3) & ~w.rlike(r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]") & w.rlike(r"\p{IsUppercase}"),
    )


def emotion_hits(text: Column, tokens: Column) -> Column:
    """array<boolean> of the fired rules, in rule order."""
    caps = F.size(caps_words(tokens))
    shout = text.rlike("[!]{3,}")
    special = {
        "caps-lock": (caps >= 2) | ((caps == 1) & (F.size(tokens) <= 3)),
        "double-exclamation": text.rlike("[!]{2}") & ~shout,
        "short-aggressive": (F.size(tokens) < 6) & text.rlike("[!?]") & ~shout,
    }
    return F.array(
        *[special[name] if pattern is None else text.rlike(f"(?iuUd){pattern}") for _, _, name, pattern in EMOTION_RULES]
    )


def emotion_reading(hits: Column) -> Column:
    """struct<emotion, confidence, signals>; on a tie the later class wins."""
    fired = [(cls, weight, name, hits[i]) for i, (cls, weight, name, _) in enumerate(EMOTION_RULES)]
    scored = F.array(
        *[
            F.struct(
                reduce(lambda a, b: a + b, [F.when(hit, w).otherwise(0) for c, w, _, hit in fired if c == cls]).alias("score"),
                F.lit(i).alias("order"),
                F.lit(cls).alias("emotion"),
            )
            for i, cls in enumerate(EMOTION_CLASSES)
        ]
    )
    top = F.array_max(scored)
    return F.struct(
        F.when(top["score"] == 0, "neutral").otherwise(top["emotion"]).alias("emotion"),
        F.least(F.lit(1.0), top["score"] / 4.0).alias("confidence"),
        F.array_compact(F.array(*[F.when(hit, name) for _, _, name, hit in fired])).alias("signals"),
    )


def detect_emotion(text: Column) -> Column:
    """The reading of one text; over a table prefer ``text.tag_emotion``."""
    return emotion_reading(emotion_hits(text, words(text)))


#: Letters that the rule takes for one of a technical word's, though their lower case is another.
ODD_FOLDS = "ı\u1c80\u1c81\u1c82\u1c83\u1c84\u1c85"


def names_tech(sentence: Column) -> Column:
    """Whether a technical word occurs; the rule runs only where one may, told by plain comparison."""
    marks = [w.lower() for w in TECH_WORDS.strip("()").split("|")] + [*ODD_FOLDS]
    may = let(F.lower(sentence), lambda t: reduce(lambda a, b: a | b, [t.contains(m) for m in marks]))
    return may & sentence.rlike(f"(?iu){TECH_WORDS}")


def placement_scores(sentence: Column) -> Column:
    """struct<prefix, mid, suffix> chances for an insertion; words are counted once."""
    return let(F.size(words(sentence)), lambda n_words: _placement_scores(sentence, n_words))


def _placement_scores(sentence: Column, n_words: Column) -> Column:
    clauses = F.size(F.split(sentence, ",", -1))
    suffix = F.when(strip(sentence).endswith("?"), 0.0).otherwise(0.55 + F.when(n_words > 8, 0.2).otherwise(0.0))
    prefix = 0.25 + F.when(names_tech(sentence), 0.2).otherwise(0.0) + F.when(n_words > 12, 0.1).otherwise(0.0)
    empty = sentence == ""
    return F.struct(
        F.when(empty, 0.0).otherwise(prefix).alias("prefix"),
        F.when(empty, 0.0).otherwise(F.least((clauses - 1) * 0.4, F.lit(1.0))).alias("mid"),
        F.when(empty, 0.0).otherwise(suffix).alias("suffix"),
    )


def pause_budget_ms(parts: Column) -> Column:
    """Sum of the pause budgets of a stroke array's delimiters."""
    from voxframe.functions.tables import BREAK_MS

    budget = F.create_map(*[F.lit(x) for kv in BREAK_MS.items() for x in kv])
    return F.aggregate(
        parts, F.lit(0).cast("bigint"), lambda s, p: s + F.coalesce(F.try_element_at(budget, p["delimiter"]), F.lit(0))
    )


def wer_tokens(text: Column) -> Column:
    """Lower-cased words with punctuation removed."""
    return words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " "))


def log_event(line: Column) -> Column:
    """struct<event, fields...> of a training-log line; null for noise and blanks.

    The first matching rule is looked for once a line; only its captures are taken.
    """
    return let(strip(line), _log_event)


def _log_event(text: Column) -> Column:
    def contains_any(marks: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [text.contains(m) for m in marks])

    hit: list[tuple[Column, str, dict[str, Column]]] = []
    for event, kind, test, captures in LOG_RULES:
        if kind == "has":
            hit.append((reduce(lambda a, b: a & b, [text.contains(t) for t in test]), event, {}))
        elif kind == "re":
            groups = {name: F.regexp_extract(text, test, i + 1) for i, name in enumerate(captures)}
            hit.append((text.rlike(test), event, groups))
        else:
            name, separator = captures
            tail = F.element_at(F.split(text, _literal(separator), -1), -1)
            hit.append((text.contains(test), event, {name: tail}))
    hit.append((contains_any(LOG_OOM), "oom", {}))
    hit.append((contains_any(LOG_ERRORS), "error", {}))

    def first(values: list[tuple[Column, Column]]) -> Column:
        out = None
        for cond, value in values:
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out

    noise = contains_any(LOG_NOISE) | reduce(lambda a, b: a | b, [text.startswith(p) for p in LOG_NOISE_PREFIXES])
    names = F.array(*[F.lit(e) for _, e, _ in hit], F.lit(None).cast("string"), F.lit("log"))
    rule = first([(c, F.lit(i)) for i, (c, _, _) in enumerate(hit)]).when(noise, len(hit)).otherwise(len(hit) + 1)

    def read(at: Column) -> Column:
        event = F.element_at(names, at + 1)

        def field(name: str) -> Column:
            return first([(at == i, groups[name]) for i, (_, _, groups) in enumerate(hit) if name in groups])

        columns = [F.when(text != "", event).alias("event")]
        for name in LOG_INT_FIELDS:
            value = field(name).try_cast("bigint")
            if name in ("wav_files", "transcripts"):
                value = F.when(event == "dataset_ready", F.coalesce(value, F.lit(0).cast("bigint")))
            columns.append(value.alias(name))
        columns += [field(name).try_cast("double").alias(name) for name in LOG_FLOAT_FIELDS]
        columns += [field(name).alias(name) for name in LOG_TEXT_FIELDS]
        columns.append(F.when(event.isin("oom", "error", "log"), text).alias("message"))
        return F.struct(*columns)

    return let(rule, read)


def _literal(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in text)


def progress(line: Column) -> Column:
    """struct<step, total, loss, accuracy> of a progress line (nulls otherwise)."""
    part = lambda i: F.regexp_extract(line, PROGRESS, i)
    return F.struct(
        part(1).try_cast("bigint").alias("step"),
        part(2).try_cast("bigint").alias("total"),
        part(3).try_cast("double").alias("loss"),
        part(4).try_cast("double").alias("accuracy"),
    )


def terminal_state(line: Column) -> Column:
    failed = reduce(lambda a, b: a | b, [line.contains(m) for m in FAILED_MARKS])
    return F.when(line.contains("[train] DONE"), "done").when(failed, "failed")
