"""Model steps of a question batch: normalise, route, guess an answer, rewrite, check. Each has its prompt, what is made of the
reply, and what holds where the model fails; a model is any function from prompts to replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import providers
from paperloom.functions import text as T

# --- fixed values that results depend on ---
NORMALISE = """请将用户问题改写为适合知识库缓存命中的标准问法。

要求：
1. 保留原始问题的核心意图、关键实体、约束条件和时间/数量条件。
2. 去掉口语化、寒暄、无意义语气词和重复表达。
3. 将同义问法统一成稳定表达，例如“咋办/怎么处理/如何处理”统一为“如何处理”。
4. 不要扩展问题，不要补充用户没有给出的条件。
5. 只输出改写后的问题，不要解释。

用户问题：%s
"""
ROUTE = """请将用户的知识库问题严格分类为一个标签。

SIMPLE：问题只询问单个事实、定义、数值、名称、时间、状态，或只需要简短直接回答。
示例：员工年假有几天？
示例：API 限流是多少？

STANDARD：问题是常规的操作方法、列表、规则、制度、流程说明或一般解释，通常只需要正常检索即可回答。
示例：新员工入职第一天需要完成哪些事项？
示例：代码提交规范有哪些要求？

COMPLEX：问题需要比较、原因分析、多步推理、跨多个文档综合、方案设计、诊断排查、权衡取舍或较宽泛的分析。
示例：对比 HR 制度和技术规范中对员工日常工作的要求，它们分别关注哪些方面？
示例：如果员工反馈系统接口调用失败，结合技术规范分析可能原因，并给出排查步骤。

如果问题包含入职时长、工作年限、服务期限、试用期、合同期限、有效期、间隔天数等时间条件，并且需要把这些条件换算或映射到文档规则中，先按语义分类，系统会自动将结果升一级，最高到 COMPLEX。

只能返回一个大写标签：SIMPLE、STANDARD 或 COMPLEX。
不要解释，不要输出其他内容。

用户问题：%s
"""
GUESS = """请根据以下问题，生成一个简洁的假设性回答（2-4句话）。
这个回答不需要准确，只需要在语义上覆盖可能的答案内容。
直接给出答案内容，不要任何前缀说明。

问题：%s
"""
REWRITE = """请将以下问题改写成3个不同表达方式的查询，要求：
1. 保持原始意图不变
2. 每个查询角度略有不同（换词、换句式、从不同维度提问）
3. 每行一个查询，不要编号，不要任何额外说明

原始问题：%s
"""
CHECK = """请判断以下【答案】是否忠实于【参考内容】（即答案中的事实是否都能在参考内容中找到依据）。

【问题】：%s

【参考内容】：
%s

【答案】：
%s

请回答以下内容（格式严格按照示例）：
忠实性分数：[0-10的整数，10=完全忠实，0=完全不忠实]
是否忠实：[是/否]
理由：[一句话解释]
"""
CHECK_FAILED = "检测失败，默认通过"
# --- end of fixed values ---


def _prompt(template: str, *columns: Column) -> Column:
    return F.format_string(template, *[F.coalesce(c, F.lit("")) for c in columns])


def normalized(question: Column, ask: providers.Ask | None = None) -> Column:
    """The question as a cache knows it: the model's reply tidied; without a model, or where it fails or says nothing, the question itself."""
    own = T.strip(F.coalesce(question, F.lit("")))
    if ask is None:
        return T.normalized_question(question)
    reply = T.normalized_question(providers.answer(_prompt(NORMALISE, own), ask))
    return F.when(own == "", "").otherwise(F.coalesce(T.blank_to_null(reply), own))


def routed(question: Column, ask: providers.Ask | None = None, enabled: bool = True) -> Column:
    """SIMPLE, STANDARD or COMPLEX by the model's label, or by length and wording without one; STANDARD where routing is off."""
    if not enabled:
        return F.lit("STANDARD")
    return T.route(question, providers.answer(_prompt(ROUTE, question), ask) if ask else None)


def hypothesis(question: Column, ask: providers.Ask) -> Column:
    """A made-up answer whose vector is sought too; the question where the model fails."""
    return providers.answer(_prompt(GUESS, question), ask, question)


def rewrites(question: Column, ask: providers.Ask) -> Column:
    """Other wordings as lines, for retrieve.expanded(); null where the model fails."""
    return providers.answer(_prompt(REWRITE, question), ask)


def checked(question: Column, answer: Column, context: Column, ask: providers.Ask, compat: bool = True) -> Column:
    """(score, faithful, reason) of an answer against its context; a failing model passes it with 0.5."""
    reply = providers.answer(_prompt(CHECK, question, context, answer), ask)
    failed = F.struct(F.lit(0.5).alias("score"), F.lit(True).alias("faithful"), F.lit(CHECK_FAILED).alias("reason"))
    return F.when(reply.isNull(), failed).otherwise(T.faithfulness(reply, compat))


def with_hypotheses(questions: DataFrame, ask: providers.Ask, embed: providers.Embed, only: Column | None = None) -> DataFrame:
    """questions with hyde_embedding: the vector of a made-up answer; null where `only` does not hold."""
    vector = providers.embedding(hypothesis(F.col("question"), ask), embed)
    return questions.withColumn("hyde_embedding", vector if only is None else F.when(only, vector))
