"""Column functions on text: cleaning, line predicates, sections, token estimates, query terms, citations.

All are built-in expressions, so they stay in code generation and can be pushed down. White space means what the
regular expressions here say; lengths count code points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that results depend on ---
#: White space beyond ASCII that strip() removes (no-break spaces stay).
WIDE_SPACE = r"[\s\x{001c}-\x{001f}\x{3000}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{1680}]"
SPACES = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000))
)  # the same as characters
CJK = r"\x{4e00}-\x{9fff}"
SECTION_TYPES: dict[str, tuple[str, ...]] = {
    "ABSTRACT": ("abstract", "summary", "摘要"),
    "INTRODUCTION": ("introduction", "引言", "导言"),
    "RELATED_WORK": ("related work", "prior work", "literature review", "相关工作", "文献综述"),
    "BACKGROUND": ("background", "preliminaries", "背景", "预备知识"),
    "METHOD": ("method", "methods", "methodology", "approach", "model", "proposed method", "方法", "模型", "方法论"),
    "EXPERIMENTS": ("experiments", "experiment", "experimental setup", "evaluation", "实验", "实验设置", "评估"),
    "RESULTS": ("results", "result", "analysis", "结果", "结果分析"),
    "DISCUSSION": ("discussion", "讨论"),
    "LIMITATIONS": ("limitations", "limitation", "局限", "局限性"),
    "CONCLUSION": ("conclusion", "conclusions", "conclusion and future work", "future work", "结论", "总结"),
    "REFERENCES": ("references", "reference", "bibliography", "参考文献"),
    "APPENDIX": ("appendix", "appendices", "supplementary material", "附录"),
}
SECTION_PREFIX = r"^(?:[0-9]+(?:\.[0-9]+)*|[ivxlcdmIVXLCDM]+)\s*[.)-]?\s+"
STOP_WORDS = (
    "的", "了", "是", "在", "有", "和", "与", "或", "这", "那", "什么", "怎么", "如何", "为什么", "哪些", "怎样", "请问",
    "a", "an", "the", "is", "are", "what", "how",
)
NOISE_PHRASES = ("proceedings of", "conference on neural information processing systems", "copyright", "all rights reserved")
NOISE_STARTS = r"^(?:arxiv:\d{4}\.\d{4,5}|preprint|under review|published as)"
PAGE_NUMBER = r"^(?:\d{1,4}|(?:page|p\.)\s*\d{1,4}|\d{1,4}\s*/\s*\d{1,4}|-\s*\d{1,4}\s*-)$"
TABLE_CAPTION = r"(?i)^table\s+[ivxlcdm0-9]+\s*[:.\-]?.*"
TIME_RULE = (
    r"(?:入职|工作|在职|服务|满|未满|不足|超过).*(?:月|年|天)|试用期|合同.*(?:期限|到期)|有效期|(?:间隔|距).*(?:天|月|年)"
    r"|多久.*(?:年假|假期|权限|资格)|几天年假|年限|工龄|司龄|\d+\s*(?:天|个月|月|年|小时)"
)
COMPLEX_RULE = "对比|比较|区别|为什么|原因|影响|分析|诊断|排查|方案|设计|规划|总结|综合|多个|多篇|优缺点|权衡|流程|步骤|详细"
QUOTES = "\"'“”‘’"
CITATION = r"\[ref(\d+)\]"
# --- end of fixed values ---


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def blank_to_null(text: Column) -> Column:
    return F.when(~is_blank(text), text)


def collapse(text: Column) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def unix_newlines(text: Column) -> Column:
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def _two_newlines(text: Column) -> Column:
    return F.when(text.contains("\n\n\n"), F.regexp_replace(text, "\n{3,}", "\n\n")).otherwise(text)


def lines(text: Column) -> Column:
    """Lines of a text, trailing empty ones dropped; none for a blank text."""
    cut = F.rtrim(unix_newlines(text), F.lit("\n"))
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.split(cut, "\n"))


def clean_keeping_columns(text: Column) -> Column:
    return strip(_two_newlines(unix_newlines(F.coalesce(text, F.lit("")))))


def clean(text: Column) -> Column:
    tidy = F.regexp_replace(unix_newlines(F.coalesce(text, F.lit(""))), "[ \t]+", " ")
    return strip(F.regexp_replace(tidy, "\n{3,}", "\n\n"))


def noise_key(line: Column) -> Column:
    return F.lower(collapse(line))


def may_be_short(line: Column, most: int) -> Column:
    """False for most lines with a noise_key of more than `most` characters, told without making it: white space alone gets shorter."""
    wide = F.length(strip(line)) <= most
    for gap in ("  ", "\t", "\n", "\x0b", "\f", "\r"):
        wide = wide | line.contains(gap)
    return wide


def is_page_number(line: Column) -> Column:
    return strip(line).rlike(PAGE_NUMBER)


def is_running_head(line: Column) -> Column:
    # long lines are told by their length alone; lower case is never shorter
    low = strip(F.lower(line))
    hit = low.rlike("|".join((NOISE_STARTS, *map(re.escape, NOISE_PHRASES))))
    return (F.length(strip(line)) <= 180) & (F.length(low) <= 180) & hit


def repeat_threshold(total_pages: Column) -> Column:
    return F.greatest(F.lit(3), F.least(total_pages, F.ceil(total_pages * F.lit(0.35).cast("double")))).cast("int")


def table_caption(line: Column) -> Column:
    own = strip(line)
    return F.when(F.length(own).between(8, 300) & own.rlike(TABLE_CAPTION), own)


def _heading_key(heading: Column) -> Column:
    bare = F.lower(F.regexp_replace(heading, SECTION_PREFIX, ""))
    return collapse(F.regexp_replace(bare, f"[^a-z0-9{CJK} ]", " "))


def section_type(heading: Column) -> Column:
    """Section type of a heading line, null for anything else."""
    own = collapse(heading)
    names = F.create_map(*[F.lit(x) for kind, keys in SECTION_TYPES.items() for key in keys for x in (key, kind)])
    return F.when(F.length(own).between(2, 120), F.try_element_at(names, _heading_key(own)))


def section_title(heading: Column) -> Column:
    return F.when(section_type(heading).isNotNull(), collapse(heading))


def first_section(text: Column) -> Column:
    """(section_title, section_type) of the first heading among the first eight lines, blank ones counted."""
    head = F.slice(F.split(text, r"\r\n|[\n\x0b\f\r\x{0085}\x{2028}\x{2029}]"), 1, 8)
    found = F.transform(head, lambda x: F.struct(collapse(x).alias("section_title"), section_type(x).alias("section_type")))
    return F.when(~is_blank(text), F.try_element_at(F.filter(found, lambda x: x["section_type"].isNotNull()), F.lit(1)))


def infer_section(title: Column, content: Column) -> Column:
    return F.coalesce(section_type(title), first_section(content)["section_type"])


def page_content_type(text: Column) -> Column:
    rest = F.regexp_replace(text, r"(?s)\[TABLE\].*?\[/TABLE\]", "")
    rest = F.regexp_replace(rest, r"(?s)\[TABLE_CAPTION\].*?\[/TABLE_CAPTION\]", "")
    kind = F.when(strip(rest) == "", "TABLE").otherwise("MIXED")
    return F.when(F.coalesce(text, F.lit("")).contains("[TABLE]"), kind).otherwise("TEXT")


def chunk_content_type(text: Column, page_type: Column) -> Column:
    kept = F.when(~is_blank(page_type) & (page_type != "MIXED"), page_type).otherwise("TEXT")
    return F.when(F.coalesce(text, F.lit("")).contains("[TABLE]"), "TABLE").otherwise(kept)


def estimate_tokens(text: Column) -> Column:
    """1.5 for each CJK ideograph and 0.3 for each other character that is not white space, truncated."""
    han = F.length(F.regexp_replace(text, f"[^{CJK}]+", ""))
    rest = F.length(F.regexp_replace(text, f"[{CJK}{WIDE_SPACE[1:-1]}]+", ""))
    return F.coalesce((han * F.lit(1.5) + rest * F.lit(0.3)).cast("int"), F.lit(0))


def lexemes(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def query_terms(query: Column) -> Column:
    """Search terms of a question: no stop words, at least two characters; else its first 20; null for a blank one."""
    parts = F.filter(F.split(query, r"[\s\p{P}]+"), lambda t: (F.length(strip(t)) >= 2) & ~F.lower(t).isin(*STOP_WORDS))
    return F.when(~is_blank(query), F.when(F.size(parts) > 0, parts).otherwise(F.array(F.substring(query, 1, 20))))


def route(question: Column, label: Column | None = None) -> Column:
    """SIMPLE, STANDARD or COMPLEX: by a model's label or else by length and wording, raised a level by time sums."""
    own = strip(question)
    rule = own.rlike(COMPLEX_RULE)
    guess = F.when((F.length(own) <= 24) & ~rule, "SIMPLE").when((F.length(own) >= 80) | rule, "COMPLEX").otherwise("STANDARD")
    if label is not None:
        up = F.upper(strip(label))
        told = F.when(up.contains("COMPLEX"), "COMPLEX").when(up.contains("SIMPLE"), "SIMPLE").otherwise("STANDARD")
        guess = F.when(label.isNull(), guess).otherwise(told)
    raised = F.when(guess == "SIMPLE", "STANDARD").otherwise("COMPLEX")
    return F.when(is_blank(question), "STANDARD").otherwise(F.when(question.rlike(TIME_RULE), raised).otherwise(guess))


def normalized_question(text: Column) -> Column:
    bare = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), f"^[{QUOTES}]+|[{QUOTES}]+$", "")
    return collapse(bare)


def cited(answer: Column) -> Column:
    """Distinct reference numbers in order of first mention; numbers beyond an int are skipped."""
    found = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    numbers = F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return F.when(answer.isNull(), F.array().cast("array<int>")).otherwise(F.array_distinct(numbers))


def without_citations(answer: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(answer, F.lit("")), r"\(source: (?:\[ref\d+\])+\)", "")
    return collapse(F.regexp_replace(bare, r"\[ref\d+\]", ""))


def excerpt(text: Column, size: int = 200) -> Column:
    return F.substring(text, 1, size)


def preview(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def faithfulness(reply: Column, compat: bool = True) -> Column:
    """(score, faithful, reason) of a three-line verdict. compat joins all digits of the score line, so 8/10 gives 81."""
    last = lambda label: F.try_element_at(F.filter(F.split(reply, "\n"), lambda x: x.startswith(label)), F.lit(-1))
    line = last("忠实性分数：")
    digits = F.regexp_replace(line, "[^0-9]", "") if compat else F.regexp_extract(line, r"(\d+)", 1)
    verdict = strip(F.regexp_replace(last("是否忠实："), "是否忠实：", ""))
    return F.struct(
        F.coalesce(F.when(digits != "", digits.cast("double") / 10.0), F.lit(0.5)).alias("score"),
        F.coalesce(verdict == "是", F.lit(True)).alias("faithful"),
        F.coalesce(strip(F.regexp_replace(last("理由："), "理由：", "")), F.lit("")).alias("reason"),
    )
