"""Tagging questions by intent, glossary terms, and recent turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inquest.functions.strings import strip, words

# The words each intent is recognised by, in the order they are tried.
GREETING = (r"(?i)^\s*(hi+|hello|hey|salam|assalam|assalamu|aoa|greetings"
            r"|good (morning|evening|afternoon))\b")
FAREWELL = (r"(?i)^\s*(bye|goodbye|good night|khuda hafiz|allah hafiz|see you"
            r"|that'?s all|thats all|done for now)\b")
OFF_TOPIC = ("joke", "poem", "story", "recipe", "song", "weather", "translate",
             "write me a", "write a python", "write code", "who won", "your opinion",
             "what do you think about", "capital of", "how old", "math problem")
THANKS = r"(?i)\b(thanks|thank you|thx|ok|okay|got it|great|perfect|shukriya|theek)\b"
ASKS_MEANING = r"(?i)\bwhat\s+(does|do|is|are)\b.{0,40}\bmean(s)?\b"
REPORT_WORDS = ("report", "write up", "write-up", "summarise", "summarize",
                "document", "pdf", "print")
EXPLAIN_WORDS = ("explain", "simple words", "simply", "plain english", "what does that mean",
                 "what do you mean", "elaborate", "clarify", "are you sure",
                 "how do you know", "prove", "why do you say", "so what",
                 "what does it mean", "in short", "smjha", "samjha", "samjhao", "smjhao",
                 "batao", "bta do", "bata do", "matlab kya", "kya matlab", "urdu", "roman")
CAPABILITY_WORDS = ("what can you do", "how do you work", "who are you",
                    "what do you do", "help me")
UNRESOLVED_WORDS = ("not establish", "could not test", "unresolved", "what did you miss",
                    "what is missing", "rejected", "what could you not")
LIST_NOUNS = ("document", "documents", "sources", "files", "pages", "websites", "sites")
LIST_VERBS = ("kon", "kaun", "which", "what", "list", "kya", "konse", "kaunse",
              "available", "have")
DRILL_WORDS = ("break", "split", " by ", " per ", "instead", "what about",
               "how about", "drill", "segment", "cut")
DATA_WORDS = ("how many", "how much", "what columns", "which columns",
              "date range", "how many rows", "what data", "what's in",
              "whats in", "describe the data", "quality issues")
CAUSE_WORDS = ("why", "cause", "reason", "drove", "driver", "responsible")
CHANGE_WORDS = ("decline", "drop", "fall", "fell", "decrease", "loss",
                "grew", "growth", "rise", "increase", "changed", "change")
GLOSSARY_TERMS = ("health score", "driver", "association", "measurement", "verified",
                  "contribution", "mape", "confidence band", "backtest", "hypothesis",
                  "unresolved", "sensitive column", "checksum", "lineage")


def _has(text: Column, terms) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | text.contains(t)
    return hit


def glossary_term(text: Column, terms=GLOSSARY_TERMS) -> Column:
    """The longest glossary term the text contains."""
    lowered = F.lower(text)
    ordered = sorted(terms, key=lambda t: -len(t))
    hit = None
    for t in ordered:
        hit = F.when(lowered.contains(t), t) if hit is None else hit.when(lowered.contains(t), t)
    return hit


def intent(text: Column, columns: list[str] = (), has_dataset: bool = True, has_report: bool = False,
           has_documents: bool = False, awaiting: bool = False) -> Column:
    """What a message asks for. The first rule that applies decides."""
    t = F.lower(strip(text))
    count = F.size(words(t))
    if awaiting:
        return F.lit("answer_request")
    mentioned = _has(t, [c.lower() for c in columns])
    explains = t.rlike(ASKS_MEANING) | _has(t, EXPLAIN_WORDS)
    rules = [
        (t.rlike(FAREWELL) & (count <= 5), "farewell"),
        (t.rlike(GREETING) & (count <= 4), "greeting"),
        (_has(t, OFF_TOPIC), "off_topic"),
        (t.rlike(THANKS) & (count <= 4), "acknowledge"),
        (_has(t, CAPABILITY_WORDS), "capabilities"),
        (_has(t, UNRESOLVED_WORDS), "unresolved" if has_report else "unclear"),
        (_has(t, GLOSSARY_TERMS), "about_system"),
        (explains, "explain" if has_report else "unclear" if has_dataset else "need_data"),
    ]
    if has_documents:
        rules.append((_has(t, LIST_NOUNS) & _has(t, LIST_VERBS), "list_documents"))
    rules.append((_has(t, REPORT_WORDS),
                  "report" if has_report else "investigate" if has_dataset else "need_data"))
    if not has_dataset:
        rules.append((F.lit(True), "document_question" if has_documents else "need_data"))
    elif has_report:
        rules.append((mentioned & _has(t, DRILL_WORDS), "drill_down"))
    rules += [
        (_has(t, DATA_WORDS), "data_question"),
        (_has(t, CAUSE_WORDS) | _has(t, CHANGE_WORDS), "investigate"),
        (t.endswith("?") & mentioned, "drill_down" if has_report else "investigate"),
    ]
    chain = F.when(rules[0][0], rules[0][1])
    for condition, name in rules[1:]:
        chain = chain.when(condition, name)
    return chain.otherwise("unclear")


def recent_transcript(turns: DataFrame, conversation: str = "conv_id", order: str = "turn",
                      role: str = "role", text: str = "text", last: int = 6,
                      chars: int = 220) -> DataFrame:
    """The last turns of every conversation as one text, oldest first."""
    newest = Window.partitionBy(conversation).orderBy(F.desc(order))
    kept = turns.withColumn("k_", F.row_number().over(newest)).where(F.col("k_") <= last)
    line = F.concat(F.col(role), F.lit(": "), F.substring(F.coalesce(F.col(text), F.lit("")), 1, chars))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return kept.groupBy(conversation).agg(lines.alias("l")).select(
        conversation, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"),
        F.size("l").alias("turns"))
