"""Vocabularies of the medical graph. The recall lists steer extraction, the strict lists steer quality checks."""

# Fixed values throughout this file: word lists in their natural order.

RECALL_SYMPTOM_HEADINGS = "症状 临床表现 常见症状 典型症状 早期症状 伴随症状".split()
RECALL_DRUG_HEADINGS = "药物治疗 用药 药品 药物".split()
RECALL_EXAM_HEADINGS = "检查 检验 诊断依据 诊断流程 体格检查 实验室检查 影像学检查 辅助检查".split()
RECALL_TREATMENT_HEADINGS = "治疗 一般治疗 手术治疗 中医治疗 急性期治疗 康复治疗 前沿治疗".split()
RECALL_COMPLICATION_HEADINGS = "并发症 合并症".split()
RECALL_LIST_MARKERS = "包括 主要包括 有 为 如 例如 可见 可有 出现 可出现 表现为 主要表现为 症状为 特征为".split()
RECALL_SYMPTOMS = """
    头晕 头痛 发热 咳嗽 咳痰 胸痛 胸闷 心悸 气短 呼吸困难 恶心 呕吐 腹痛 腹泻 便秘 乏力 疲劳 水肿 麻木 瘙痒 黄疸 出血 贫血 视物模糊 意识丧失 昏迷 多饮
    多尿 多食 体重下降 食欲减退 心绞痛 发绀
""".split()
RECALL_SYMPTOM_ENDINGS = "痛 疼痛 热 咳 肿 麻木 困难 乏力 出血 昏迷 黄疸 心悸".split()
RECALL_DRUGS = """
    阿司匹林 胰岛素 二甲双胍 硝酸甘油 硝酸酯类 β受体阻滞剂 ACEI ARB 他汀 他汀类药物 抗血小板药 抗凝药 抗生素 降糖药 降压药 利尿剂 钙拮抗剂 青霉素 头孢
    异烟肼 利福平 乙胺丁醇 吡嗪酰胺 布洛芬 对乙酰氨基酚 奥美拉唑 硝苯地平 美托洛尔
""".split()
RECALL_EXAMS = """
    血常规 尿常规 心电图 动态心电图 超声心动图 冠脉CT血管成像 冠脉造影 胃镜 肠镜 CT MRI X线 B超 血糖检测 尿糖检测 体格检查 血液检查 影像学检查 实验室检查
    超声检查 病理检查
""".split()
RECALL_TREATMENTS = """
    手术治疗 一般治疗 中医治疗 介入治疗 放射治疗 化疗 放疗 靶向治疗 免疫治疗 生活方式干预 饮食控制 运动治疗 康复训练 康复治疗 支持治疗 对症治疗 抗感染治疗 降压治疗
    降糖治疗 补液治疗 氧疗 透析 经皮冠状动脉介入治疗 冠状动脉旁路移植术 PCI CABG 外科手术 微创手术 开放手术 营养支持 物理治疗
""".split()
RECALL_DISEASE_ENDINGS = "病 症 炎 癌 综合征 衰竭 损害 病变 感染 梗死 出血 畸形 缺陷 坏死 休克 中毒 梗阻".split()
RECALL_DISEASES = """
    高血压 糖尿病 冠心病 脑卒中 脑梗死 脑出血 心力衰竭 心律失常 心肌梗死 肾衰竭 呼吸衰竭 休克 感染 肺炎 贫血 低血糖 低钙血症 上消化道出血 消化道出血 肾功能损害
    周围神经病变 代谢综合征
""".split()
RECALL_ANCHORS = {
    "Symptom": "症状 临床表现 不适 体征",
    "Drug": "药品 药物 用药 治疗药",
    "Examination": "检查 检验 项目 诊断 检测",
    "Treatment": "非药物治疗 手术 康复 饮食 运动 介入",
    "Disease": "疾病 并发症 病变 综合征",
}
STRICT_GENERIC = "疾病 患者 医生 医院 情况 方面 方式 方法 治疗 检查 症状 原因 因素 药物 药品 手术 诊断 表现 其他 以及 包括 主要 常见 一般 严重 相关 临床 医学".split()
STRICT_GENERIC_BY_LABEL = {
    "Drug": "药 药物 药品 用药 单药 新药 中医药 中国医药 抗菌药 降压药 降糖药 利尿药".split(),
    "Examination": "检查 检测 检验 诊断 影像学检查 实验室检查 体格检查 辅助检查 该检查 这类检查".split(),
    "Symptom": "症状 体征 临床表现 表现 不适".split(),
    "Treatment": "治疗 其他治疗 合并治疗 前沿治疗 急症治疗 急性期治疗 治疗方法 治疗方式 治疗方案".split(),
}
STRICT_FRAGMENTS = """
    患者 医生 医院 需要 应该 可以 可能 由于 导致 引起 包括 例如 通常 是否 如果 对于 诊断主要 治疗目标 治疗手段 怎么治疗 怎样治疗 常用 建议 指出 启动 改善
    早餐 服药 有些 制定 漏服 标志 根据 正式获得 此类 的药 住院 属于 整个 最基本 可重复 继续 考虑 病人 非法 须测定 出现 多数 开始 处理 发病率 危险因素
    基础疾病 生活质量 指南推荐
""".split()
STRICT_DISEASE_ENDINGS = "病 症 炎 癌 综合征 衰竭 损害 病变 感染 梗死 出血 畸形 缺陷 坏死 休克 中毒 梗阻 结石 溃疡 硬化".split()
STRICT_DISEASES = """
    乳腺癌 低钙血症 冠状动脉粥样硬化性心脏病 十二指肠溃疡 心力衰竭 心律失常 慢性肾炎 慢性阻塞性肺疾病 抑郁症 支气管哮喘 甲状腺功能亢进症 甲状腺功能减退 白血病
    类风湿关节炎 糖尿病 肝硬化 肺炎 肺癌 肺结核 肾结石 胃溃疡 胃炎 胆囊炎 胆结石 胸膜炎 脂肪肝 脑出血 脑梗死 腰椎间盘突出症 贫血 颈椎病 骨质疏松症 高血压
    周围神经病变
""".split()
STRICT_SYMPTOMS = """
    头晕 头痛 发热 咳嗽 咳痰 胸痛 胸闷 心悸 气短 呼吸困难 恶心 呕吐 腹痛 腹泻 便秘 乏力 疲劳 水肿 麻木 瘙痒 黄疸 出血 贫血 昏迷 眩晕 压痛 反跳痛 厌食
    多饮 多尿 多食 消瘦 体重下降 视物模糊 意识丧失 发绀 尿频 尿急 尿痛 抽搐 休克
""".split()
STRICT_SYMPTOM_ENDINGS = "痛 疼痛 发热 咳嗽 咳痰 胸闷 心悸 气短 困难 乏力 水肿 麻木 瘙痒 黄疸 出血 昏迷 眩晕 压痛 反跳痛 便秘 腹泻 恶心 呕吐 厌食 发绀".split()
STRICT_DRUGS = """
    ACEI ARB DPP-4抑制剂 GLP-1受体激动剂 SGLT-2抑制剂 PD-1抑制剂 PD-L1抑制剂 β受体阻滞剂 β受体拮抗剂 阿司匹林 胰岛素 二甲双胍 硝酸甘油
    硝酸酯类 他汀 他汀类药物 抗血小板药 抗凝药 抗生素 头孢 青霉素 异烟肼 利福平 乙胺丁醇 吡嗪酰胺 布洛芬 对乙酰氨基酚 奥美拉唑 硝苯地平 美托洛尔 中草药 中药制剂
""".split()
STRICT_DRUG_FRAGMENTS = """
    一些 一种 两种 多种 新的 这些 不当 不要 停止 随意 交叉耐药 危险因素 严格控制 推荐 与机体 与胰岛素 和皮质激素 要应用 要进行 还应 进行药 谨慎 用药 足量
    加强 对耐多药 耐多药 可给予 继续用药 使用药 致病因素 因素 元素 口服铁剂 口服 选用 抵消 作为药 代表性 优先 停用 其中 具体 减少 分别 切忌 自行 考虑
    全身应用 单凭 只适用于 合理规范 同时 联合用药 所需 将麻醉 尚无 尽早 第二天 积极的 西药 方剂 成药 抑制甲状腺激素
""".split()
STRICT_DRUG_MARKERS = "药物 剂 胺 酯 苷 霉素 沙星 头孢 青霉素 胰岛素 双胍 地平 洛尔 普利 沙坦 他汀 拉唑 西林 抑制剂 阻滞剂 拮抗剂 激动剂".split()
STRICT_EXAMS = """
    CT MRI X线 B超 CCT ECT LDCT PCT PET-CT 心电图 血常规 尿常规 胃镜 肠镜 冠状动脉造影 冠状动脉CT血管成像 超声心动图 动态心电图
    13C或14C尿素呼气试验
""".split()
STRICT_EXAM_MARKERS = "检查 检测 检验 测定 试验 造影 心电图 CT MRI X线 B超 超声 胃镜 肠镜 血常规 尿常规 PET-CT".split()
STRICT_EXAM_FRAGMENTS = """
    是 比 每 年内 最常见 常用检查 诊断是 检测是 需要进行 通过 采用 有无 之前 技术 传统 不耐受 已将 已能 即 发病 因此 急诊室 治疗后 疗效 无创 无放射性 相关
    基层 扫描可 完善 定期 含量的 另外
""".split()
STRICT_TREATMENTS = """
    手术治疗 外科手术 微创手术 开放手术 介入治疗 内科介入治疗 冠状动脉旁路移植术 PCI CABG 康复训练 康复治疗 饮食控制 运动治疗 生活方式干预 营养支持
    医学营养治疗 物理治疗 中医治疗 放疗 化疗 免疫治疗 靶向治疗 分子靶向治疗 透析 氧疗 成分输血治疗 对症治疗
""".split()
STRICT_TREATMENT_MARKERS = "治疗 手术 康复 训练 饮食 运动 透析 氧疗 放疗 化疗 介入 营养 物理 移植术".split()
STRICT_TREATMENT_FRAGMENTS = "药物治疗 用药 服药 药品 抗感染治疗 抗血小板 抗Hp 抑酸 激素 铁剂 降压 降糖 调脂".split()
