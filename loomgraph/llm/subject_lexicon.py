"""Curated subject terms (zh and en) of the nine subject areas.

``TERMS`` are nouns of the field; ``PASSING`` are frames that merely mention what follows or precedes them, so that a term inside them
carries no weight.  Turns of phrase that tell of a field without such a noun are learned from annotators' labels, and all weights from the
corpus (see :mod:`loomgraph.llm.subjects`).  Another lexicon of the same shape can be passed to the operator.
"""

TERMS = {
    "warfare": "号角 敌将 左翼 箭楼 骑兵 云梯 降卒 辎重 营盘 鹿砦 前锋营 盾车 残部 粮道 弓弩手 壕沟 战船 烽烟 斥候 令旗 伏兵 枪阵|"
    "spearmen|siege ladder|left wing|scouts|ambush|war boats|palisade|vanguard|garrison|cavalry|archers|signal drums|enemy captain|supply train|rear guard",
    "court": "奏折 太后 储位 御史 藩王 诏书 起居注 廷议 尚书 外戚 贬谪 吏部 圣旨 密折 内阁 俸禄 翰林 玉玺 宫门 早朝 党争|"
    "privy letter|memorial|minister|faction|imperial seal|dawn audience|cabinet|stipend|edict|regent|censor|appointment|palace gate|exile order|succession",
    "household": "管家婆 庚帖 针线 嫁妆 婆母 嫡出 媒人 绣房 陪房 祠堂座次 内院 满月酒 闺阁 寿宴 厨下 回门 妯娌 分家 月例 乳母 小姑|"
    "family quarrel|needlework|kitchen keys|dowry|birthday feast|mother-in-law|inner court|betrothal card|wet nurse|monthly allowance|matchmaker|lady's maid|wedding visit|nursery|ancestral hall",
    "trade": "茶引 掌秤 行价 利钱 压价 赊欠 驮队 本钱 账房 货单 定银 盐引 牙行 货栈 船脚 绸缎庄 银票 当铺 分号 码头 布匹|"
    "credit|pawn shop|mule train|salt permit|bank draft|broker|silk shop|invoice|warehouse|counting house|market price|deposit|wharf|capital|cargo",
    "law": "保人 衙役 人证 缉捕 赃物 案卷 判牍 刑名 供词 画押 堂审 诬告 惊堂木 讼师 状纸 翻案 杖责 仵作 牢头 流放 械具|"
    "pleader|witness|coroner|case file|warrant|stolen goods|beating|verdict|hearing|complaint|confession|jailer|false charge|magistrate|banishment",
    "medicine": "舌苔 煎药 热毒 疮口 药引 银针 当归 虚火 避瘟 咳血 汤剂 疟疾 问诊 黄芪 敷药 膏药 寒症 药方 艾灸 脉象 郎中|"
    "herbs|plague|prescription|diagnosis|sores|needles|fever|physician|ague|moxa|ointment|decoction|cough|poultice|pulse",
    "religion": "还愿 经卷 佛龛 丹炉 方丈 舍利 打醮 云游僧 木鱼 禅房 法坛 斋饭 超度 度牒 冤魂 符箓 香火 卦象 阴司 道场 托梦|"
    "shrine|incense|ghost|hexagram|abbot|talisman|altar|exorcism|pilgrim monk|vow|relic|omen|underworld|sutra|rite",
    "arts": "弦音 笔意 行草 琴谱 诗社 碑帖 韵脚 题跋 律诗 酒令 曲牌 画轴 联句 折子戏 山水小幅 丹青 残局 印章 棋局 词牌 笛声|"
    "poetry club|rubbing|linked lines|regulated verse|rhyme|tune|opera|chess game|lute score|drinking verse|scroll|colophon|seal carving|landscape|brushwork",
    "farming": "粪肥 堤坝 粮囤 耕牛 桑叶 秧苗 春播 镰刀 田契 佃户 旱情 谷种 蝗灾 麦垄 水渠 塘泥 蚕室 犁铧 打谷场 水车 秋收|"
    "drought|draught ox|tenants|dike|ploughshare|mulberry leaves|seedlings|harvest|locusts|seed grain|canal|sowing|threshing floor|wheat rows|water wheel",
}

#: Frames of a mention in passing.
PASSING = "说笑间扯到 随口提起 戏台上正唱到 莫提 比作|in passing|say nothing of|a storyteller had come to|joked that"


def entries(table: dict[str, str]) -> list[tuple[str, str]]:
    """(subject, entry) of a table; in its strings the part before the first bar holds words of zh, parted by blanks, the rest entries of en."""
    out = []
    for subject, text in table.items():
        zh, *en = text.split("|")
        out += [(subject, t) for t in [*zh.split(), *en]]
    return out


def passing() -> list[str]:
    zh, *en = PASSING.split("|")
    return [*zh.split(), *en]
