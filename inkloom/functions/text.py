"""Text functions as column expressions; offsets and lengths count code points."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks that end a sentence, and the marks that close after them.
SENTENCE_ENDS = "。！？!?"
SENTENCE_CLOSERS = "”’\"」』】））》〉〕〗〙〛)]"
# Blanks as written out, since engines differ on what a blank is.
BLANK = r" \t\n\r\x{3000}"
# What a number in a heading may be written with, and the headings of volumes and chapters.
HEADING_NUMBER = "[零〇一二两三四五六七八九十百千万兩0-9]+"
VOLUME_HEADINGS = ["第{num}[卷部篇]"]
CHAPTER_HEADINGS = ["第{num}章", "第{num}话", "第{num}節", "第{num}节", "序章", "序曲", "终章", "終章", "尾声", "尾聲", "后记", "後記"]
# Names that name nobody.
UNSAFE_NAMES = ["主人公", "主角", "叙事者", "叙述者", "旁白", "我", "你", "他", "她", "它", "学生", "同学", "narrator", "protagonist", "main character", "i", "you", "he", "she", "it", "student"]
NARRATOR = "Environment"


def normalize_newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip(text: Column) -> Column:
    """Without blanks at the ends, wide ones included."""
    return F.regexp_replace(text, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def sentence_pattern(ends: str = SENTENCE_ENDS) -> str:
    """A regex whose successive matches are the sentences of a text, each with the blanks after it; nothing is lost."""
    marks = "".join(re.escape(c) for c in ends)
    closers = "".join("\\" + c if c in "])" else c for c in SENTENCE_CLOSERS)
    return rf"(?s).*?(?:[{marks}]+[{closers}]*|\n[ \t\x{{3000}}]*\n)[{BLANK}]*|(?s).+"


def split_sentences(text: Column, ends: str = SENTENCE_ENDS) -> Column:
    """The sentences of a text; a blank or null text has none."""
    return F.when(strip(text) != "", F.regexp_extract_all(text, F.lit(sentence_pattern(ends)), F.lit(0))).otherwise(F.array().cast("array<string>"))


def trimmed_sentences(text: Column, ends: str = SENTENCE_ENDS) -> Column:
    """The sentences without blanks around them; empty ones go."""
    return F.filter(F.transform(split_sentences(text, ends), strip), lambda s: s != "")


def heading_pattern(markers: Sequence[str]) -> str:
    """A regex for a whole heading line; ``{num}`` stands for a number, ``re:`` passes a pattern as it is."""
    parts = []
    for marker in markers:
        if not marker or marker == "re:":
            raise ValueError("a heading marker is empty")
        parts.append(marker[3:] if marker.startswith("re:") else marker.replace("{num}", HEADING_NUMBER))
    return rf"^[ \t\x{{3000}}]*(?:{'|'.join(f'(?:{p})' for p in parts)})[^\r\n]*$"


def parse_line(line: Column) -> dict[str, Column]:
    """Kind, speaker and content of one line of a prompt: narration, ``name: words`` with a name of at most 40, else surroundings."""
    bare = strip(line)
    narration = bare.rlike(r"(?s)^\*\(.*[^ \t\n\r\x{3000}].*\)\*$")
    name = strip(F.regexp_extract(bare, r"(?s)^([^:：\n]{1,40})[:：](.*)$", 1))
    words = strip(F.regexp_extract(bare, r"(?s)^([^:：\n]{1,40})[:：](.*)$", 2))
    spoken = ~narration & (name != "") & (words != "")
    return {
        "kind": F.when(narration, "narration").when(spoken, "speech").otherwise("plain"),
        "speaker": F.when(spoken, F.when(name.rlike("^未知角色[0-9]*$"), "").otherwise(name)).otherwise(NARRATOR),
        "content": F.when(spoken, words).otherwise(bare),
    }


def is_narration(text: Column) -> Column:
    """Whether a text is ``*(...)*`` with something visible inside."""
    return F.coalesce(text.rlike(r"(?s)^\*\(.*[^ \t\n\r\x{3000}].*\)\*$"), F.lit(False))


def slug(text: Column) -> Column:
    """An ASCII slug, else the text with reserved marks as dashes, else ``dataset``."""
    ascii_ = F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    wide = F.regexp_replace(F.regexp_replace(strip(text), r"[\x{00}-\x{1f}<>:\"/\\|?*]+", "-"), r"^[ .\-]+|[ .\-]+$", "")
    return F.coalesce(F.nullif(ascii_, F.lit("")), F.nullif(wide, F.lit("")), F.lit("dataset"))


def safe_filename(text: Column) -> Column:
    """Reserved marks become ``_``; dots, dashes and spaces go from the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x{00}-\x{1f}<>:\"/\\|?*]+", "_"), r"^[ .\-]+|[ .\-]+$", "")


def normalize_title(text: Column, most: int = 60, default: str = "New chat") -> Column:
    """Blanks collapsed, ends trimmed, cut; the default if nothing is left."""
    return F.coalesce(F.nullif(F.substring(strip(F.regexp_replace(text, rf"[{BLANK}]+", " ")), 1, most), F.lit("")), F.lit(default))


def natural_key(path: Column) -> Column:
    """A sort key in which runs of digits compare as numbers and letters without case."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(path), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def html_to_text(html: Column) -> Column:
    """Without scripts, styles and tags; blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"<[^<>]+>", " "), rf"[{BLANK}]+", " "))


def match_text(text: Column) -> Column:
    """For comparing: without blanks and punctuation, in lower case."""
    return F.lower(F.regexp_replace(text, rf"[{BLANK}\p{{P}}]+", ""))


def repair_json(text: Column) -> Column:
    """Without a fence and what is outside the outermost brackets, and without trailing commas."""
    inner = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```[a-zA-Z]*[ \t]*\n(.*?)\n?```", 1), F.lit("")), text)
    cut = F.regexp_extract(inner, r"(?s)[{\[].*[}\]]", 0)
    return F.regexp_replace(cut, r",([ \t\r\n]*[}\]])", "$1")


def state_name(name: Column) -> Column:
    """``Entity.attribute``, with the attributes for a place brought to ``location``; null if it isn't of that form."""
    entity, attribute = F.regexp_extract(name, r"^([^.]+)\.([^.]+)$", 1), F.regexp_extract(name, r"^([^.]+)\.([^.]+)$", 2)
    return F.when(name.rlike(r"^[^.]+\.[^.]+$"), F.concat(entity, F.lit("."), F.when(attribute.isin("位置", "地点"), "location").otherwise(attribute)))


def occurrences(text: Column, needle: Column) -> Column:
    """All starts of ``needle``, overlapping ones too, from 0.

    The text is split before every occurrence; the pieces' lengths add up to
    the starts.
    """
    pieces = F.split(text, F.concat(F.lit(r"(?=\Q"), needle, F.lit(r"\E)")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    ends = F.aggregate(pieces, start, lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")), lambda s: s["starts"])
    found = F.when(F.startswith(text, needle), ends).otherwise(F.slice(ends, 2, F.greatest(F.size(ends) - 1, F.lit(0))))
    return F.when(F.length(needle) > 0, found).otherwise(F.array().cast("array<int>"))


def find_from(text: Column, needle: Column, start: Column) -> Column:
    """The first start of ``needle`` at or after ``start``, from 0; -1 if there is none."""
    return F.call_function("locate", needle, text, start + 1) - 1


def relative_path_ok(path: Column) -> Column:
    """Whether a path is inside a workspace: not empty, not absolute, without ``..``."""
    return F.coalesce((path != "") & ~path.rlike(r"^(?:[/\\]|[A-Za-z]:)") & ~F.array_contains(F.split(path, r"[/\\]"), ".."), F.lit(False))


def safe_names(names: Column) -> Column:
    """Trimmed names without those that name nobody, in order, each once."""
    kept = F.filter(F.transform(names, strip), lambda n: n.isNotNull() & (n != "") & ~F.lower(n).isin(UNSAFE_NAMES))
    return F.array_distinct(kept)


def permissive_int(text: Column) -> Column:
    """An integer written in digits, null otherwise."""
    return F.when(strip(text).rlike("^[0-9]{1,18}$"), F.regexp_extract(text, "[0-9]+", 0).try_cast("bigint"))


def speaker_line(speaker: Column, content: Column, colon: str = "：") -> Column:
    """``speaker：content``; without a speaker the content alone."""
    return F.when(F.coalesce(strip(speaker), F.lit("")) == "", content).otherwise(F.concat(speaker, F.lit(colon), content))


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` places; what is filled in isn't looked at again."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def without_newlines(text: Column) -> Column:
    """CR and LF deleted."""
    return F.translate(text, "\r\n", "")
