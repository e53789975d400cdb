"""Citations, verdicts on answers, and the decision whether an answer may be given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

# Prompts, messages and the marks of a verdict.
SYSTEM_PROMPT = """你是一个严谨的问答助手。
仅使用以下参考资料回答问题。如果参考资料中没有相关信息，直接告知用户无相关资料，禁止编造。
回答时请在相关句子末尾标注对应的引用编号，例如 [1]、[2]。

参考资料：
{context}

问题：{question}
"""
VERIFICATION_PROMPT = """请判断以下回答是否完全基于提供的参考资料。
如果回答中的信息在参考资料中找不到依据，标记为幻觉。

参考资料：
{context}

回答：
{answer}

请按以下格式输出：
幻觉判定：是/否
幻觉部分：（列出具体幻觉内容，若无则填"无"）
置信度：0.0 ~ 1.0
"""
REJECTION = "无法从提供的资料中找到相关信息，请补充更多资料后重试。"
NO_CONTEXT, SERVICE_FAILED, UNREADABLE = "参考资料为空，无法验证", "幻觉检测服务异常，暂时无法验证", "无法解析验证结果"
VERDICT, PART, DETAIL, CONFIDENCE, YES, NONE, COLON = "判定", "幻觉部分", "具体", "置信度", "是", "无", "："


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_citations(answer: Column | str) -> Column:
    """Numbers of ``[n]`` in order, repeated ones too; a number beyond int is an error."""
    return F.transform(F.regexp_extract_all(F.coalesce(_c(answer), F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def invalid_citations(answer: Column | str, sources: Column | str) -> Column:
    """Cited numbers outside 1..sources, in order."""
    n = F.coalesce(_c(sources), F.lit(0))
    return F.filter(extract_citations(answer), lambda x: (x < 1) | (x > n))


def fill_prompt(template: str, **parts: Column) -> Column:
    """The template with ``{name}`` replaced; inserted text is not searched again for other names."""
    out = [F.lit("")]
    rest = template
    while rest:
        found = sorted((i, name) for name in parts if (i := rest.find("{" + name + "}")) >= 0)
        if not found:
            out.append(F.lit(rest))
            break
        i, name = found[0]
        out += [F.lit(rest[:i]), F.coalesce(parts[name], F.lit(""))]
        rest = rest[i + len(name) + 2 :]
    return F.concat(*out)


def prompt_with_constraints(question: Column, context: Column) -> Column:
    return fill_prompt(SYSTEM_PROMPT, question=question, context=context)


def parse_verdict(output: Column | str) -> Column:
    """A model's verdict as ``struct(has_hallucination, details, confidence)``.

    The last line that names the verdict decides, yes wherever the yes mark occurs in
    it; details are what follows the first colon unless it says none; the last
    confidence is clamped to [0, 1], unreadable ones are 0.5.
    """
    o = _c(output)
    lines = F.transform(F.split(o, "\n"), trimmed)
    verdicts = F.transform(F.filter(lines, lambda x: x.contains(VERDICT)), lambda x: x.contains(YES))
    after = lambda x: trimmed(F.substring(x, F.instr(x, COLON) + 1, F.length(x)))
    details = F.filter(F.transform(F.filter(lines, lambda x: x.contains(PART) | x.contains(DETAIL)), after), lambda x: x != NONE)
    numbers = F.transform(F.filter(lines, lambda x: x.contains(CONFIDENCE)), lambda x: F.coalesce(F.regexp_replace(x, "[^0-9.]", "").try_cast("double"), F.lit(0.5)))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit(0.5))))
    read = F.struct(F.coalesce(F.try_element_at(verdicts, F.lit(-1)), F.lit(False)).alias("has_hallucination"), details.alias("details"), confidence.alias("confidence"))
    return F.when(F.coalesce(o.rlike(r"\S"), F.lit(False)), read).otherwise(_verdict(True, [UNREADABLE], 0.5))


def _verdict(bad: bool, details: list[str], confidence: float) -> Column:
    return F.struct(F.lit(bad).alias("has_hallucination"), F.array(*map(F.lit, details)).cast("array<string>").alias("details"), F.lit(confidence).alias("confidence"))


def check_answer(context: Column | str, answer: Column | str, output: Column | str, failed: Column | None = None) -> Column:
    """The verdict, unless context or answer is blank or the model failed."""
    blank = lambda c: ~F.coalesce(_c(c).rlike(r"\S"), F.lit(False))
    out = F.when(blank(context), _verdict(True, [NO_CONTEXT], 1.0)).when(blank(answer), _verdict(False, [], 0.0))
    if failed is not None:
        out = out.when(F.coalesce(failed, F.lit(False)), _verdict(True, [SERVICE_FAILED], 0.5))
    return out.otherwise(parse_verdict(output))


def gate(answers: DataFrame) -> DataFrame:
    """Decide on ``(answer, sources, has_hallucination)``: adds ``final_answer`` and ``flag``.

    Without sources the rejection is given; so it is if any citation is invalid, and
    the flag is set then and where a hallucination was found.
    """
    bad = F.size(invalid_citations("answer", "sources")) > 0
    none = F.coalesce(F.col("sources"), F.lit(0)) == 0
    final = F.when(none | bad, F.lit(REJECTION)).otherwise(F.col("answer"))
    flag = F.when(none, 0).otherwise((bad | F.coalesce(F.col("has_hallucination"), F.lit(False))).cast("int"))
    return answers.withColumn("final_answer", final).withColumn("flag", flag)
