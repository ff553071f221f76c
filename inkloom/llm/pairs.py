"""Problem 1: broken prompt and response pairs, by ordered rules.

The rules run from the most to the least certain: nothing said, a refusal, a
copy of the prompt, another language, a cut.  Every rule that holds is named in
``defects``; ``defect`` is the first of them.  The rules are column
expressions, and for pieces of words a join with the words of all responses;
only the endings that lack a final stop and that no rule decides go through
the trained ending model, and ``cut_by`` says so.

Defined results: a null response is ``empty``; a null or missing prompt can't
be copied and has no language; a null id keeps its row; a repeated row gives
one result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.llm import endings
from inkloom.session import cut, table

# What stands for nothing, in the languages of the corpus.
PLACEHOLDERS = ["none", "null", "nil", "n/a", "na", "nan", "undefined", "empty", "blank", "no reply", "no response", "no answer", "no content", "nothing", "tbd", "todo", "ninguno", "ninguna", "sin respuesta", "vacío", "nulo", "keine", "keine antwort", "leer", "无", "無", "空", "无回复", "无回答", "暂无", "没有回复", "なし", "無し", "空白", "未回答", "回答なし"]
# Words of refusals by a model, by language.
REFUSALS = [
    # English
    r"\bas an ai\b|\b(?:ai|large) language model|\blanguage model\b|\bai (?:assistant|model)\b|\b(?:virtual|digital) assistant\b",
    r"\b(?:can'?t|can’t|cannot|can not|unable to|not able to|won'?t|won’t|must decline|have to decline|decline to|refuse to|don'?t feel comfortable|don’t feel comfortable|not comfortable)\b[^.!?]{0,60}\b(?:role-?play\w*|requests?|prompts?|generate|generating|dialogue|(?:this|that|the) (?:scene|story|turn|conversation|character|person|scenario)|next line|content|repl(?:y|ies)|responses?|answering as)\b",
    r"\b(?:guidelines?|policy|policies)\b[^.!?]{0,60}\b(?:prevent|prohibit|forbid|allow|restrict)|\b(?:against|violate\w*) (?:the|my|our|its)? ?(?:\w+ )?(?:policy|policies|guidelines)\b|\bcontent policy\b",
    r"\bnot something i can (?:assist|help)\b|\bis there (?:something|anything) else\b|\bno (?:response|reply|answer) can be (?:given|provided|generated)\b|\bsafer (?:prompt|request)\b|\bprompt you (?:supplied|provided|gave)\b",
    # Spanish
    r"modelo de (?:lenguaje|ia)|asistente virtual|inteligencia artificial|normas de uso|pol[ií]ticas? de (?:contenido|uso)|juego de rol|\bindicaci[oó]n m[aá]s segura",
    r"\bno (?:puedo|es posible|me es posible|me est[aá] permitido|debo|estoy autorizad[oa])\b[^.!?]{0,60}\b(?:solicitud|petici[oó]n|respuesta|generar|esta escena|di[aá]logo|este personaje|esta conversaci[oó]n|esta historia|contenido)\b",
    # German
    r"sprachmodell|ki-modell|ki-assistent|virtuelle[rn]? assistent|künstliche intelligenz|inhaltsrichtlinie|nutzungsrichtlinie|nutzungsbedingung|rollenspiel|andere anfrage|diese anfrage|ihre anfrage|deine anfrage",
    r"\b(?:kann|darf|möchte|werde) (?:ich )?[^.!?]{0,50}\b(?:dieser szene|diese szene|diese antwort|diesen dialog|diese unterhaltung|diese figur|antwort)\b[^.!?]{0,20}\bnicht|\b(?:kann|darf) (?:ich )?[^.!?]{0,50}(?:antwort|szene|dialog)[^.!?]{0,30}nicht (?:geben|generieren|erstellen|verfassen|helfen)",
    # Chinese
    r"人工智能|语言模型|語言模型|虚拟助手|虛擬助手|智能助手|AI助手|角色扮演|内容(?:规范|政策|准则)|使用(?:规范|政策)|(?:该|这个|您的|此|这一)请求|换一个(?:提示|话题|问题|请求)|不便回答|(?:无法|不能|不便|没法)(?:协助|提供|继续这|生成|回答|完成这)|还有其他需要",
    # Japanese
    r"ロールプレイ|言語モデル|アシスタント|人工知能|ガイドライン|ポリシー|リクエスト|プロンプト|別の質問|(?:お答え|対応|お手伝い|生成|回答|お応え)(?:することは)?でき(?:ません|かねます)|続けることはできません|応じることはできません",
]
# Frequent words that no other of these languages shares.
FUNCTION_WORDS = {
    "en": "the|and|of|is|you|your|that|with|not|for|were|this|have|had|who|are|to|it|she|he|they|we|if|but|my|i|from|there|would|what|only|before|than|which|at|by",
    "es": "el|la|los|las|de|del|que|y|un|una|con|por|para|nos|se|ese|esa|está|estamos|al|en|si|su|pero|yo|nunca|alguien|ningún|había|como|lo|le|sin",
    "de": "der|die|das|und|ist|ich|nicht|ein|eine|einen|einer|wir|sind|mit|den|dem|bei|diese|dieser|aber|nach|von|zu|im|du|auf|keine|wenn|dich|sich|als|doch|habe|wer|oder|ohne",
}
# What parts words.
SEPARATORS = "\n\r\t\u00a0\u3000.,;:!?¿¡()[]{}<>/\\|*_\"“”„«»‹›…—–―-0123456789&%#@+=~^`$、。！？：；，（）「」『』【】《》"
_WIDE = "[\u3041-\u9fff]"
_NOISE = r"[\s\p{Cf}\p{Cc}\x{00a0}\x{3000}\x{2800}\x{3164}]"


def _norm(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def _words_of(low: Column, language_: str) -> Column:
    return F.size(F.array_intersect(low, F.array(*[F.lit(w) for w in FUNCTION_WORDS[language_].split("|")])))


def with_language(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``en``, ``es``, ``de``, ``zh`` or ``ja`` by script and different function words, null if too little is said.

    The steps are columns of their own, so that each is computed once.
    """
    col = F.col(text)
    # Counting characters and splitting at one blank are several times faster than replacing and splitting by patterns.
    words = F.array_distinct(F.split(F.translate(F.lower(col), SEPARATORS, " " * len(SEPARATORS)), " "))
    df = df.withColumns({"_han": F.regexp_count(col, F.lit(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]")), "_kana": F.regexp_count(col, F.lit(r"[\x{3041}-\x{30ff}\x{ff66}-\x{ff9f}]")), "_latin": F.regexp_count(col, F.lit(r"[A-Za-z\x{c0}-\x{24f}]")), "_words": words})
    df = df.withColumns({f"_{k}": _words_of(F.col("_words"), k) for k in FUNCTION_WORDS})
    best = F.greatest(*[F.col(f"_{k}") for k in FUNCTION_WORDS])
    latin = F.when(F.lit(False), F.lit(""))
    for name in FUNCTION_WORDS:
        others = F.greatest(*[F.col(f"_{k}") for k in FUNCTION_WORDS if k != name])
        latin = latin.when((F.col(f"_{name}") == best) & (best > 2 * others) & (best > 1), F.lit(name))
    wide = F.col("_han") + F.col("_kana")
    found = F.when((wide > 0) & (wide * 3 > F.col("_latin")), F.when(F.col("_kana") * 12 > F.col("_han"), F.lit("ja")).when(F.col("_kana") == 0, F.lit("zh"))).otherwise(latin)
    return df.withColumn(out, found).drop("_han", "_kana", "_latin", "_words", *[f"_{k}" for k in FUNCTION_WORDS])


def _refused(low: Column) -> Column:
    """Whether lower-case text has a refusal in any language; patterns that hold Chinese or Japanese characters are tried where such occur."""
    wide = [p.replace("AI助手", "ai助手") for p in REFUSALS if re.search(_WIDE, p)]
    narrow = [p for p in REFUSALS if not re.search(_WIDE, p)]
    any_of = lambda patterns: low.rlike("|".join(f"(?:{p})" for p in patterns))
    return any_of(narrow) | F.when(low.rlike(_WIDE), any_of(wide)).otherwise(F.lit(False))


def _copied(said: list[str], forms: list[str]) -> Column:
    """Whether any normal form of the response gives back one of the prompt; forms that equal an earlier one aren't tried again."""
    out = F.lit(False)
    for i, s in enumerate(map(F.col, said)):
        for j, n in enumerate(map(F.col, forms)):
            size, other = F.length(s), F.length(n)
            near = F.least(F.greatest(F.lit(4), F.floor(other * 0.07)), F.floor(other * 0.15)).cast("int")
            fits = (other >= 6) & (size >= other * 0.7) & (other >= size * 0.7)
            digits = F.regexp_replace(s, r"\D+", "") == F.regexp_replace(n, r"\D+", "")
            edited = F.when((F.abs(size - other) <= near) & digits, F.call_function("levenshtein", s, n, near) >= 0).otherwise(F.lit(False))
            again = F.lit(False)
            for e in said[:i]:
                again = again | (s == F.col(e))
            for e in forms[:j]:
                again = again | (n == F.col(e))
            out = out | F.when(fits & ~again, F.contains(n, s) | F.contains(s, n) | edited).otherwise(F.lit(False))
    return F.coalesce(out, F.lit(False))


def rules(pairs: DataFrame) -> DataFrame:
    """Add the rules' outcome to ``response``, ``prompt``, ``context``: ``defects`` in order, and ``open_end`` where only the model can tell."""
    label = r"(?m)^[ \t]*[^:：\n]{1,40}[:：][ \t]*"
    narration = r"(?s)\*\(.*?\)\*"
    df = pairs.withColumn("_text", F.coalesce(F.col("response"), F.lit(""))).withColumn("_low", F.lower("_text"))
    df = with_language(with_language(df, "_text", "_mine"), "context", "_theirs")
    df = df.withColumns({"_bare": F.trim(F.regexp_replace("_low", _NOISE + "+", " ")), "_unlabelled": F.regexp_replace("prompt", label, ""), "_spoken": F.regexp_replace(F.regexp_replace("prompt", narration, ""), label, "")})
    df = df.withColumns({"_said": _norm(F.col("_text")), "_said_plain": _norm(F.regexp_replace("_text", label, "")), "_n_prompt": _norm(F.col("prompt")), "_n_unlabelled": _norm(F.col("_unlabelled")), "_n_spoken": _norm(F.col("_spoken"))})
    text, bare = F.col("_text"), F.col("_bare")
    core = F.when(F.length(bare) < 40, F.trim(F.regexp_replace(bare, r"^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$", ""))).otherwise(bare)
    placeholder = core.isin(PLACEHOLDERS) & ~bare.rlike(r"[.!?。！？]$|[,;，；]")
    silent = ~bare.rlike(r"[\p{L}\p{N}]")
    df = df.withColumns({"_empty": silent | placeholder, "_trails": endings.trails_off(text), "_stops": endings.stopped(text) | text.rlike(rf"[{re.escape(endings.CLOSERS)}]\s*\z")})
    said, forms = ["_said", "_said_plain"], ["_n_prompt", "_n_unlabelled", "_n_spoken"]
    comma = text.rlike(r"[,，、;；:：\-‐‑(（「『“„¿¡]\s*\z")
    flags = {"refusal": _refused(F.col("_low")), "copy": _copied(said, forms), "language": F.coalesce(F.col("_mine") != F.col("_theirs"), F.lit(False)), "truncated": ~F.col("_trails") & (comma | endings.unclosed(text) | (~F.col("_stops") & endings.stops_before(text)))}
    df = df.withColumns({f"_{k}": ~F.col("_empty") & v for k, v in flags.items()})
    named = F.array_compact(F.array(*[F.when(F.col(f"_{k}"), F.lit(k)) for k in ("empty", *flags)]))
    return df.select(*pairs.columns, named.alias("defects"), (~F.col("_empty") & ~F.col("_truncated") & ~F.col("_trails") & ~F.col("_stops")).alias("open_end"))


def _judge(model: endings.EndingModel):
    """Name the cuts among the endings that the rules left open."""

    def run(batches):
        for batch in batches:
            tails, pieces, defects = (batch.column(i).to_pylist() for i in (2, 3, 1))
            evidence = ["rule" if "truncated" in (d or []) else None for d in defects]
            at = [i for i, t in enumerate(tails) if t is not None]
            for i, s in zip(at, model.score([tails[i].rstrip() for i in at])):
                if pieces[i] or s <= 0:
                    defects[i] = [*(defects[i] or []), "truncated"]
                    evidence[i] = "piece" if pieces[i] else "model"
            # Sound pairs are dropped here: a filter on the rules would be pushed into them and compute them again.
            kept = [i for i, d in enumerate(defects) if d]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array([defects[i] for i in kept], pa.list_(pa.string())), pa.array([evidence[i] for i in kept], pa.string())], ["candidate_id", "defects", "cut_by"])

    return run


def defects(candidates: DataFrame, sample: int = endings.SAMPLE_TEXTS) -> DataFrame:
    """``candidate_id, defect, defects, cut_by`` of the defective rows of a table of candidates.

    ``cut_by`` says what showed a cut: a ``rule`` (an open delimiter, a mark or
    a word that can't be the last), a ``piece`` of a word, or, where no rule
    holds, the ending ``model``; null if nothing is cut.
    """
    last = F.element_at(F.filter("messages", lambda m: m["role"] == "user"), -1)
    before = F.when(F.try_element_at("messages", F.lit(-1))["role"] == "assistant", F.slice("messages", 1, F.greatest(F.size("messages") - 1, F.lit(0)))).otherwise(F.col("messages"))
    context = F.array_join(F.transform(before, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    pairs = candidates.select("candidate_id", F.col("reference_response").alias("response"), F.when(F.size("messages") > 0, last["content"]).alias("prompt"), context.alias("context"))
    model = endings.train(endings.sample_texts(pairs, "response", F.col("candidate_id"), sample))
    tail = F.when(F.col("open_end"), F.expr("right(response, 400)"))
    ruled = cut(rules(pairs).select("candidate_id", "defects", tail.alias("tail")).withColumn("word", F.coalesce(endings.last_word(F.col("tail")), F.lit(""))), "ruled")
    pieces = endings.pieces_of_words(ruled, endings.inner_words(pairs, "response")).withColumn("piece", F.lit(True))
    judged = ruled.join(pieces, "word", "left").select("candidate_id", "defects", "tail", "piece")
    found = judged.mapInArrow(_judge(model), "candidate_id bigint, defects array<string>, cut_by string")
    return found.select("candidate_id", F.col("defects")[0].alias("defect"), "defects", "cut_by").distinct()


def p1_found(spark, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "candidates")).select("candidate_id", "defect")


def p1_defects(spark, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "candidates")).select("candidate_id", "defect", F.array_join("defects", ",").alias("defects"), "cut_by")
