"""Word lists, labels and constants that results depend on, stated as they are."""

from __future__ import annotations

# Fixed values. Dictionary keywords of the lexical tokenizer by topic.
TOPIC_KEYWORDS = {
    "customer_value": ["顾客", "客户", "用户", "新客户", "价值", "创造顾客", "客户减少", "增长放缓"],
    "opportunity": ["机会", "增长", "创新", "未来", "新市场", "新产品", "探索", "开拓"],
    "strategy_organization": ["战略", "组织", "部门", "协同", "执行", "资源", "目标传递"],
    "metrics": ["指标", "KPI", "考核", "衡量", "数据", "目标", "效率", "成本"],
    "self_drive": ["自驱", "管控", "审批", "员工", "责任", "授权", "目标混乱", "忙"],
}

# Fixed values. BM25, fusion and candidate sizes.
BM25_K1, BM25_B = 1.5, 0.75
LINEAR_WEIGHTS = {"bm25": 0.15, "embedding": 0.85}
RRF_K = 60

# Fixed values. Chunk sizes in code points.
FIXED_SIZES = (900, 1800)
TARGET_CHARS, MAX_CHARS, OVERLAP_CHARS = 900, 1200, 180
SEMANTIC_START, SEMANTIC_WINDOW, SEMANTIC_BREAK, SEMANTIC_MIN = 600, 150, 0.55, 300

# Fixed values. Weights of metadata fields in search text.
METADATA_WEIGHTS = {
    "summary": 1,
    "extracted.concept_keywords": 2,
    "extracted.method_keywords": 2,
    "extracted.named_entities": 2,
    "inferred.symptom_keywords": 3,
    "inferred.diagnosis_labels_zh": 3,
    "inferred.diagnosis_tags": 3,
    "inferred.recommended_methods": 2,
}

# Fixed values. Keywords that route a description to problem types.
PROBLEM_KEYWORDS = {
    "customer_value_misalignment": ["顾客", "客户", "用户", "新客户", "客户减少", "增长放缓", "增长变慢", "价值", "客户价值", "顾客价值", "需求", "产品没人用", "转化下降", "复购下降"],
    "opportunity_neglect": ["机会", "创新", "新市场", "新产品", "探索", "开拓", "增长机会", "未来", "试错", "业务停滞", "没有新方向"],
    "strategy_execution_gap": ["战略", "执行", "落地", "协同", "部门", "资源", "战略目标", "战略不清楚", "各做各的", "目标传递", "组织承接"],
    "metrics_misalignment": ["指标", "KPI", "考核", "衡量", "数据", "目标", "目标混乱", "成本", "效率", "降本增效", "绩效", "短期指标"],
    "control_over_self_drive": ["管控", "审批", "流程", "员工", "责任", "授权", "自驱", "主动性", "被动", "很忙", "只是在完成任务", "等指令", "目标不清楚"],
    "short_term_decision_bias": ["短期", "今天", "长期", "未来", "决策", "短期收益", "只看眼前", "长期能力", "牺牲长期"],
    "entrepreneurial_leadership_gap": ["企业家", "领导力", "老板", "管理层", "负责人", "使命", "责任", "决策能力", "方向感", "领导团队"],
}
GENERAL_PROBLEM = "general_management_diagnosis"

# Fixed values. Labels of problem types.
PROBLEM_LABELS = {
    "customer_value_misalignment": "客户价值错配",
    "opportunity_neglect": "机会忽视",
    "strategy_execution_gap": "战略执行脱节",
    "metrics_misalignment": "指标错配",
    "control_over_self_drive": "对自驱力的过度控制",
    "short_term_decision_bias": "短期决策偏差",
    "entrepreneurial_leadership_gap": "企业家领导力缺口",
    "general_management_diagnosis": "一般管理诊断",
    "other": "其他",
}

# Fixed values. Labels of metadata records and the tags they stand for.
LABEL_TAGS = {
    "客户价值错位": "customer_value_misalignment",
    "机会识别不足": "opportunity_neglect",
    "战略执行脱节": "strategy_execution_gap",
    "指标体系错位": "metrics_misalignment",
    "过度控制抑制自驱": "control_over_self_drive",
    "短期决策偏差": "short_term_decision_bias",
    "企业家领导力缺口": "entrepreneurial_leadership_gap",
    "通用管理问题": "general_management_diagnosis",
}

# Fixed values. Guidance of each problem type, part of rule-based retrieval queries.
PROBLEM_HINTS = {
    "customer_value_misalignment": "Focus on whether the company has lost clarity about its core customers, whether internal efficiency is being mistaken for customer value creation, and whether current work truly improves customer value.",
    "opportunity_neglect": "Focus on whether management is only solving current problems instead of identifying future opportunities, new customer needs, new products, or new markets.",
    "strategy_execution_gap": "Focus on whether strategy is actually carried by organizational structure, resources, department goals, roles, processes, and daily decisions.",
    "metrics_misalignment": "Focus on whether KPIs and metrics serve the real business goal, or whether they distort employee behavior and weaken customer value.",
    "control_over_self_drive": "Focus on whether excessive control, approval, or task-based management is weakening employee responsibility, initiative, and self-driven action.",
    "short_term_decision_bias": "Focus on whether current decisions are over-optimized for short-term efficiency or cost while weakening future value creation and long-term capability.",
    "entrepreneurial_leadership_gap": "Focus on whether leadership has enough clarity about mission, opportunity, responsibility, and decision-making discipline.",
    "general_management_diagnosis": "Provide a general management diagnosis based on customer value, opportunity, strategy, metrics, organizational responsibility, and future-oriented decision making.",
}

# Fixed values. Markers that ask for an output language.
ENGLISH_MARKERS = ["answer in english", "reply in english", "respond in english", "use english", "用英文", "英文回答", "英语回答"]
CHINESE_MARKERS = ["用中文", "中文回答", "用汉语", "汉语回答", "answer in chinese", "reply in chinese"]

# Fixed values. Terms and messages of the clarity check.
SIGNAL_TERMS = ["客户", "用户", "增长", "战略", "组织", "团队", "指标", "KPI", "效率", "成本", "员工", "管理", "决策", "价值", "销售", "目标", "流程", "授权", "责任"]
CONCRETE_TERMS = ["下降", "下滑", "减少", "增加", "上升", "流失", "投诉", "离职", "延期", "返工", "亏损", "利润", "复购", "续约", "审批", "冲突", "积压", "主动性"]
VAGUE_TERMS = ["帮我看看", "给点建议", "有问题", "不太好", "状态不好", "业绩一般", "怎么办"]
MIN_DESCRIPTION, MIN_SIGNALS = 20, 2
CLARITY_ISSUES = {
    "short": "The problem description is too short.",
    "signals": "The description has too few management diagnosis signals.",
    "concrete": "The description lacks a concrete management symptom or fact.",
    "vague": "The request is too vague to diagnose responsibly.",
}
CLARITY_QUESTIONS = ["请说明当前最明显的业务或管理问题是什么。", "请提供一两个具体变化或事实，例如客户流失、业绩下降、员工离职、流程效率或 KPI 行为变化。", "你最希望解决或诊断的问题是什么？"]

# Fixed values. Report sections and the words and messages of the report checks.
SECTIONS = ["core_diagnosis", "management_concepts", "root_causes", "recommendations"]
RECOMMENDATION_WORDS = (["建议", "行动"], ["recommendation", "action"])
ASSUMPTION_WORDS = (["假设", "缺失信息"], ["assumption", "missing information"])
GENERIC_PHRASES = ["加强管理", "提升效率", "优化流程", "提高竞争力"]
LENGTH_NOTES = ["字数", "字符数", "token", "tokens", "word count", "character count"]
SENTENCE_ENDS = ["。", "！", "？", ".", "!", "?", "）", ")"]
BRACKETS = [("（", "）"), ("(", ")"), ("「", "」"), ("“", "”"), ("《", "》")]
REPORT_ISSUES = {
    "empty": "The report is empty.",
    "short": "The report is too short to be useful.",
    "citation": "The report does not cite retrieved knowledge items using the required format.",
    "source": "The report should not expose raw source file paths or source IDs.",
    "recommendation": "The report does not include clear practical recommendations.",
    "assumption": "The report does not clearly separate assumptions or missing information.",
    "generic": "The report may contain generic management advice without enough specificity.",
    "length_notes": "The report includes word count or length notes, which should not be included.",
    "ending": "The report appears to be incomplete or truncated.",
    "brackets": "The report may contain unmatched brackets or quotation marks.",
}
CITATION = r"(?i)(?:知识项\s*|knowledge\s+item\s*)\[?\s*(\d+)\s*\]?"
NOTHING_RETRIEVED = "未检索到相关管理知识。"

# Fixed values. Patterns of sentences, headings and tables of contents.
SENTENCE = "[^.!?。！？；;]+[.!?。！？；;]?"
SENTENCE_COMMA = "[^.!?。！？；;，]+[.!?。！？；;，]?"
CJK = "一-鿿"
