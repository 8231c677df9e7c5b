"""Default word lists, patterns and settings of the rules. Every operator takes its own as arguments."""

# These must equal the published rules for equal results.

NOISE_PATTERNS = (
    r"\d+\s*[\+\-\*/]\s*\d+", "等于多少", "计算.*结果",
    r"\d+\s*(米|厘米|千克|克|斤|公里|英里)", "多少(米|厘米|千克|克)", "换算",
    "现在几点", "今天.*号", "星期几", "what time",
    "今天天气", "明天.*天气", "weather",
    "帮我搜索", "帮我查", "search for", "google",
    "翻译[:：]", "translate", "用.*语.*说",
    r"定时\d+分钟", "提醒我", "set.*timer", "remind me",
    r"^what is \d+", "^who is", "^where is", "^when is",
)
NOISE_KEYWORDS = (
    "计算器", "搜索", "查询", "帮我找", "翻译", "定时", "闹钟", "提醒",
    "单位换算", "多少钱", "怎么走", "路线", "导航", "地图",
    "什么意思", "怎么读", "怎么写", "拼音", "英文", "中文",
)
CONVERSATION_NOISE = (
    "^(你好|hi|hello|嗨)", "^(谢谢|thanks|thank you)", "^(再见|bye|goodbye)", "^(好的|ok|okay|行)",
    "^(是的|对|没错|yes)", "^(不是|不对|no)", "^(嗯|啊|哦)",
    "^(哈哈|呵呵|笑死)", "^(😂|😄|😊|👍)",
)
DISTRACTION_PATTERNS = (
    "求解.*方程", "证明.*定理", "计算.*积分",
    "写.*代码", "实现.*函数", "debug",
    "解释.*概念", "什么是.*理论", ".*的定义",
)
LEGACY_NOISE = {
    "pure_interjection": ("[哈嘿呵嗯啊哦噢呃唉嘛吧啦呀咯嘞哇喔]+[~～.!?]*", "[oO]+[kK]+[~～.!?]*", "[yY]e+[sS]*[~～.!?]*", "[nN]o+[~～.!?]*", "[lL][oO]+[lL]+[~～.!?]*"),
    "simple_ack": ("(好的?|行|可以|没问题|收到|了解|明白|懂了?|知道了?|OK|ok|嗯|对|是的?)[~～.!?]*", "(谢谢|感谢|thanks?|thx)[~～.!?]*", "(不用|不必|算了|没事|无所谓)[~～.!?]*"),
    "emoji_only": (r"[\x{1F300}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\s~～.!?]+", r"[.,!?~～\s]+"),
    "too_short": (".{0,2}",),
}
IMPORTANCE_CLASSES = (
    ("identity_health_safety", 1.0, ("过敏", "疾病", "病", "健康", "安全", "紧急", "危险", "我叫", "我是", "我的名字", "身份证", "电话", "地址", "密码", "账号", "银行", "死", "生命")),
    ("preference_relation_status", 0.8, ("喜欢", "讨厌", "爱", "恨", "偏好", "习惯", "朋友", "家人", "父母", "妈妈", "爸爸", "兄弟", "姐妹", "换工作", "搬家", "毕业", "结婚", "离婚", "分手", "开始", "结束", "改变")),
    ("project_task_goal", 0.7, ("项目", "任务", "目标", "计划", "deadline", "截止", "开发", "设计", "实现", "完成", "进度")),
    ("temporary", 0.2, ("今天", "明天", "刚才", "一会儿", "待会", "马上", "顺便", "随便", "无所谓")),
)
GENERAL_IMPORTANCE = ("general_fact", 0.5)
BOOSTS = ((0.5, ("记住", "永远记住", "一定要记住", "以后都", "永远都")), (0.3, ("重要", "关键", "必须", "一定")), (0.2, ("注意", "别忘了")))
REDUCE = (-0.2, ("顺便说一下", "随便问问", "不重要", "无所谓"))
BELIEF_WORDS = ("可能", "也许", "大概", "应该", "似乎", "看起来", "我觉得", "我认为", "我猜", "估计", "probably", "maybe")
SUMMARY_WORDS = ("总结", "综上", "总的来说", "概括", "整体上")
URGENT_CRITICAL = ("过敏", "疾病", "死", "生命", "紧急", "危险", "急救", "密码", "账号", "银行卡", "身份证")
URGENT_IMPORTANT = ("记住", "永远记住", "一定要记住", "重要", "关键", "决定", "确定", "最终")
URGENT_TIME = ("(今天|明天|后天|下周|下个月).*(必须|一定|截止|deadline)", "(必须|一定).*(今天|明天|后天|下周)")
TTL_PERMANENT = ("我叫|我是|我的名字", "过敏|疾病|健康问题", "喜欢|讨厌|偏好", "家人|父母|兄弟|姐妹")
TTL_IMMEDIATE = ("(今天|今晚|现在|马上|立刻).*(做|去|完成|提交)", r"\d{1,2}[点时].*(会议|开会|见面)")
TTL_SHORT = ("(明天|后天|一会儿|待会).*(做|去|完成|提交)",)
TIME_SENSOR = ((12, ("今天", "今晚", "现在", "马上", "立刻")), (48, ("明天", "后天", "一会儿", "待会")), (240, ("这周", "下周", "最近")), (840, ("这个月", "下个月")))
ACTION_VERBS = ("做", "去", "完成", "提交", "开始", "结束", "处理", "解决", "写", "读", "看", "听", "说", "想", "买", "卖", "吃", "喝")
RELATION_WORDS = ("认为", "觉得", "怀疑", "可能", "也许", "大概", "据说", "听说", "似乎", "好像", "应该", "或许", "如果", "假如", "除非", "尽管", "虽然", "但是", "因为", "所以", "导致", "造成", "影响", "关系")
NEGATION_WORDS = ("不是", "没有", "并非", "其实", "实际上", "事实上", "相反", "反而", "却", "倒是", "恰恰")
METAPHOR_WORDS = ("像", "如同", "仿佛", "好比", "就像", "犹如", "简直", "堪比", "不亚于", "胜过")
TEMPORAL_WORDS = ("之前", "之后", "同时", "期间", "直到", "自从", "曾经", "一直", "最近", "将来", "过去")
TRIGGERS = (
    ("layer0_explicit", 0, ("你还记得", "帮我回忆", "之前说过", "上次提到", "我告诉过你")),
    ("layer0_time", 0, ("之前", "以前", "上次", "昨天", "前几天", "那时候", "当时")),
    ("layer1_preference", 1, ("我喜欢", "我讨厌", "我偏好", "我习惯", "我爱", "我恨")),
    ("layer1_identity", 1, ("我是", "我叫", "我的名字", "关于我")),
    ("layer1_relation", 1, ("朋友", "家人", "同事", "父母", "兄弟", "姐妹")),
    ("layer1_project", 1, ("项目", "任务", "计划", "目标", "进度")),
)
PRECISE_WORDS = ("是什么", "是谁", "在哪", "什么时候", "多少", "具体")
BROAD_WORDS = ("所有", "全部", "总结", "概括", "列出", "有哪些")
QUERY_SIZES = {"precise": (15, 10, 8), "topic": (25, 16, 13), "broad": (35, 25, 18)}
CONTRADICTION_WORDS = ("不再", "现在", "改成", "变成", "搬到", "从", "不是", "其实", "实际上", "之前", "更正", "修正", "no longer", "now", "changed to", "moved to", "actually", "not", "correction", "update")
BELIEF_NEGATIONS = ("不", "没", "无", "非", "否", "别", "不是", "没有")
OVERRIDE_TIER1 = ("不再", "改成", "换成", "搬到", "现在是", "已经是", "不是", "而是", "从", "到", "修正", "更正", "变成", "其实是", "实际上", "事实上", "准确说")
OVERRIDE_TIER2 = ("逗你的", "开玩笑", "骗你的", "瞎说的", "胡说", "刚才说错了", "说反了", "搞错了", "弄错了")
STOP_WORDS = ("的", "了", "在", "是", "我", "你", "他", "她", "它", "the", "a", "an", "is", "are", "was", "were")
FIXED_ENTITIES = ("我", "你", "他", "她", "用户", "项目", "系统", "工具", "应用", "App", "北京", "上海", "深圳", "广州", "杭州", "河南", "郑州", "公司", "学校", "大学", "医院", "团队")
NUMBERED_ENTITIES = (r"项目_\d+", r"城市_\d+", r"地点_\d+", r"组织_\d+", r"团队_\d+")
QUOTES = ("「([^」]+)」", "『([^』]+)』", "“([^”]+)”", "‘([^’]+)’", "《([^》]+)》", "'([^']+)'", '"([^"]+)"')
BUILTIN_ENTITIES = (r"机器人[_\-]?\d+", r"项目[_\-]?[A-Z]", r"城市[_\-]?\d+", r"用户[_\-]?\d+", r"Agent[_\-]?\d+", r"协议[_\-]?[A-Z]")
SOURCE_PRIORITY = {"user": 3, "assistant": 2, "third_party": 1}
DECAY_RATES = {"fact": 0.008, "belief": 0.07, "summary": 0.025}
DAILY_RATES = {"fact": 0.992, "belief": 0.93, "summary": 0.975}
ACCESS_WEIGHTS = {"retrieval": 1.0, "used_in_response": 2.0, "user_mentioned": 3.0}
