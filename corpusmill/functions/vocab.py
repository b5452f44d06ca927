"""Vocabularies and character classes. All of them are parameters of the operators; these are the defaults."""

from __future__ import annotations

#: Character classes, as Java regex class bodies.
CJK = r"\x{4e00}-\x{9fa5}"
LATIN = "a-zA-Z"
PRIVATE = r"\x{E000}-\x{F8FF}"
EXT_B = r"\x{20000}-\x{2A6DF}"
CONTROL = r"\x00-\x08\x0B-\x1F\x7F"
SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F"
#: The characters of SPACE.
SPACES = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
PUNCT = r"，。！？、；：\"'（）【】《》·—,.!?;:()\[\]<>/\\\-" + SPACE
PUNCT_ENCODING = r"，。！？、；：\"（）【】《》·—,.!?;:()\[\]<>/\\\-" + SPACE

#: Page-noise keywords and topic vocabularies.
NOISE = ["免责声明", "版权", "copyright", "disclaimer", "版权所有", "本报告", "本文件仅供"]
TOPICS = ["碳排放", "碳中和", "碳达峰", "环境", "社会", "治理", "ESG", "CSR", "可持续发展", "环保", "社会责任", "公司治理", "员工", "培训", "供应链", "合规", "风险", "创新", "质量", "安全", "能源", "水资源"]
TOPICS_DEFAULT = ["ESG", "sustainability"]

#: Vocabularies of the 15-feature extractor, with the number of hits that counts as full.
SELECTOR = {
    "has_entities": (["公司", "企业", "碳排放", "员工", "培训", "环保", "治理"], 5.0),
    "has_question_keywords": (["什么", "如何", "为什么", "哪些", "多少", "是否"], 3.0),
    "has_structured_data": (["：", "、", "；", "（", "）", "1.", "2.", "-"], 10.0),
    "esg_keyword_density": (["环境", "社会", "治理", "ESG", "CSR", "可持续发展", "碳排放", "环保", "社会责任", "公司治理", "员工", "培训", "供应链", "合规", "风险", "创新", "质量", "安全"], 9.0),
    "comparative_keywords": (["对比", "比较", "差异", "优于", "高于", "低于", "相比"], 3.0),
    "temporal_keywords": (["年", "月", "季度", "年度", "去年", "今年", "明年", "趋势", "变化", "增长", "下降"], 5.0),
    "industry_keywords": (["行业", "同行", "同类", "平均水平", "基准", "标准", "领先", "排名"], 4.0),
    "vague_commitments": (["致力于", "计划", "将", "预计", "目标", "承诺", "努力", "争取"], 4.0),
    "standard_keywords": (["GRI", "TCFD", "SASB", "ISO", "CDP", "标准", "指引", "框架", "规范", "合规"], 5.0),
    "performance_keywords": (["效果", "成效", "成果", "成绩", "表现", "绩效", "达成", "完成", "实现"], 4.0),
}
#: Patterns of verifiable claims.
CLAIMS = [r"降低[了]?\s*\d+%", r"减少[了]?\s*\d+", r"提高[了]?\s*\d+%", r"达到[了]?\s*\d+", r"实现[了]?\s*\d+"]
CLAIMS_BILINGUAL = [*CLAIMS, r"reduced by \d+", r"increased by \d+"]

#: Vocabularies of the bilingual 14-feature extractor.
BILINGUAL = {
    "temporal_markers": (["年", "月", "季度", "年度", "去年", "今年", "明年", "趋势", "变化", "增长", "下降", "since", "by 20"], 5.0),
    "standards_language": (["GRI", "TCFD", "SASB", "ISO", "CDP", "SDG", "标准", "指引", "框架", "规范", "合规"], 5.0),
    "carbon_keywords": (["碳", "排放", "emission", "carbon", "CO2", "温室气体", "GHG", "能源", "energy", "可再生", "renewable", "减排", "中和"], 6.0),
    "social_keywords": (["员工", "employee", "培训", "training", "社区", "community", "安全", "safety", "健康", "health", "多样性", "diversity"], 4.0),
    "governance_keywords": (["治理", "governance", "合规", "compliance", "董事会", "board", "审计", "audit", "风险", "risk", "反腐", "corruption"], 4.0),
    "vague_commitments": (["致力于", "计划", "将", "预计", "目标", "承诺", "努力", "争取", "committed to", "plan to", "aim to", "intend to"], 4.0),
    "comparative_language": (["对比", "比较", "差异", "优于", "高于", "低于", "相比", "higher than", "lower than", "compared to", "ranked"], 3.0),
    "industry_keywords": (["行业", "同行", "同类", "平均水平", "基准", "标准", "领先", "排名", "industry", "benchmark", "average", "peer"], 4.0),
}
BILINGUAL_MARKS = (["：", "、", "；", "（", "）", "1.", "2.", "3.", "-", "|"], 8.0)
BILINGUAL_ENTITIES = (["公司", "企业", "集团", "有限", "股份", "工厂", "厂区", "基地", "项目"], 4.0)

#: Domain vocabularies of the metrics.
INTRINSIC = ["环境", "社会", "治理", "ESG", "CSR", "可持续发展", "碳排放", "碳中和", "碳达峰", "环保", "社会责任", "公司治理", "员工", "培训", "供应链", "合规", "风险", "创新", "质量", "安全", "能源", "水资源", "废弃物", "温室气体", "GRI", "TCFD", "SASB"]
METRIC = ["环境", "社会", "治理", "ESG", "CSR", "可持续发展", "碳排放", "环保", "社会责任", "公司治理", "员工", "培训", "供应链", "合规", "风险", "创新", "质量", "安全"]
EVALUATOR = ["碳排放", "碳中和", "碳达峰", "温室气体", "气候变化", "碳足迹", "ESG", "可持续发展", "环境保护", "社会责任", "公司治理", "绿色金融", "绿色债券", "碳交易", "碳市场", "碳配额", "能源转型", "清洁能源", "可再生能源", "节能减排", "环境信息披露", "碳排放权", "低碳", "生态环境", "双碳", "碳减排", "碳排放量", "碳强度", "碳汇"]
QUALITY = [
    "碳排放", "碳中和", "碳达峰", "温室气体", "环境", "能源", "可再生", "排放量", "减排", "废弃物", "水资源", "生态", "气候", "污染",
    "scope 1", "scope 2", "scope 3", "carbon", "emission", "renewable", "GHG", "CO2", "energy", "waste", "water", "biodiversity",
    "员工", "培训", "社会", "社区", "供应链", "安全", "健康", "多样性", "人权", "劳工", "社会责任", "CSR", "employee", "safety", "diversity",
    "治理", "合规", "风险", "董事会", "审计", "反腐", "透明度", "governance", "compliance", "risk", "board", "audit",
    "ESG", "GRI", "TCFD", "SASB", "CDP", "ISO 14001", "SDG", "可持续发展", "信息披露", "disclosure",
]

#: Knowledge keywords by dimension.
KNOWLEDGE = {
    "环境": ["碳排放", "温室气体", "能源", "水资源", "废弃物", "污染", "环保", "绿色"],
    "社会": ["员工", "培训", "安全", "健康", "供应链", "社区", "公益", "社会责任"],
    "治理": ["公司治理", "合规", "风险", "内部控制", "董事会", "审计", "反腐败"],
    "GRI": ["GRI", "实质性议题", "利益相关方", "可持续发展", "ESG指标", "环境绩效", "社会绩效", "治理绩效"],
    "SDG": ["可持续发展目标", "SDG", "消除贫困", "零饥饿", "良好健康", "优质教育", "性别平等", "清洁能源", "体面工作", "产业创新"],
}

#: A Latin vocabulary for the synthetic tables, whose texts are made of such syllables and words.
LATIN_TOPICS = ["the", "tion", "heit", "ment", "ción", "ing", "ung", "eau", "ado", "wh"]

#: Experts in catalogue order, with layer and default instruction.
EXPERTS = [
    ("qa_expert", "base", "QA expert", "Generate a high-quality Q&A pair based on the text."),
    ("summary_expert", "base", "Summary expert", "Summarize the main content of the text."),
    ("extraction_expert", "base", "Extraction expert", "Extract ESG-related metrics from the text."),
    ("classification_expert", "base", "Classification expert", "Classify the text by ESG dimension (environment/social/governance)."),
    ("analysis_expert", "base", "Analysis expert", "Analyze ESG-related content in the text."),
    ("temporal_analysis_expert", "analysis", "Temporal analysis expert", "Analyze temporal patterns, commitment trends, and data continuity."),
    ("benchmark_comparison_expert", "analysis", "Benchmark comparison expert", "Compare carbon commitments in the text with industry benchmarks."),
    ("greenwashing_detection_expert", "analysis", "Greenwashing detection expert", "Identify greenwashing patterns (e.g. vague commitments, selective disclosure)."),
    ("standard_alignment_expert", "verification", "Standard alignment expert", "Identify ESG standards followed and assess compliance."),
    ("knowledge_graph_expert", "graph", "Knowledge graph expert", "Extract ESG entities and relations for a knowledge graph."),
    ("consistency_verification_expert", "verification", "Consistency verification expert", "Verify data consistency and identify contradictions or gaps."),
    ("promise_performance_verification_expert", "reserved", "Promise-performance verification expert", "Identify verifiable claims and generate tool-call instructions for verification."),
]
DEFAULT_INSTRUCTION = "Analyze the following text."
#: Task types that have one.
TASK_TYPES = {"qa_expert": "qa", "summary_expert": "summarization", "extraction_expert": "information_extraction", "classification_expert": "classification", "analysis_expert": "analysis"}
