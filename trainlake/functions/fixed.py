"""Tables, word lists and patterns that results depend on. Each is a default of a parameter."""

# Domain suffix -> authority; the first suffix in this order that fits counts.
SUFFIXES = [
    (".gov.cn", 1.00),
    (".gov", 1.00),
    (".edu.cn", 0.95),
    (".edu", 0.95),
    (".ac.cn", 0.95),
    (".ac.uk", 0.95),
    (".org.cn", 0.85),
    (".org", 0.85),
    (".int", 0.90),
    (".nhs.uk", 1.00),
    (".who.int", 1.00),
    (".com.cn", 0.55),
    (".cn", 0.55),
    (".com", 0.50),
    (".net", 0.50),
    (".io", 0.50),
    (".co", 0.50),
]
OTHER_SUFFIX = 0.35

# Host -> authority; subdomains of a host count as the host, the first in this order.
HOSTS = {
    "mayoclinic.org": 1.00,
    "health.harvard.edu": 1.00,
    "acsm.org": 1.00,
    "nih.gov": 1.00,
    "pubmed.ncbi.nlm.nih.gov": 0.98,
    "ncbi.nlm.nih.gov": 0.98,
    "cdc.gov": 1.00,
    "nhs.uk": 1.00,
    "who.int": 1.00,
    "cochrane.org": 1.00,
    "bjsm.bmj.com": 1.00,
    "sportsmedicine-open.springeropen.com": 0.95,
    "strengthandconditioning.org": 0.95,
    "sleepfoundation.org": 0.85,
    "heart.org": 0.95,
    "diabetes.org": 0.90,
    "sport.gov.cn": 1.00,
    "nhc.gov.cn": 1.00,
    "cma.org.cn": 0.95,
    "chinacdc.cn": 0.95,
    "cctv.com": 0.60,
    "people.com.cn": 0.60,
    "dxy.cn": 0.80,
    "dxy.com": 0.75,
    "haodf.com": 0.70,
    "cnki.net": 0.90,
    "wanfangdata.com.cn": 0.85,
}

# Topic -> words. Order decides ties.
TOPICS = {
    "training": [
        "训练", "跑步", "运动", "锻炼", "健身", "跑量", "配速", "间歇", "节奏跑", "长距离", "周期化", "训练计划", "力量训练", "核心", "专项", "超量恢复", "最大摄氧量",
        "乳酸阈", "跑姿", "步频", "步幅", "训练强度", "耐力", "体能", "exercise", "exercises", "exercising", "fitness", "workout", "workouts",
        "physical activity", "training", "run", "runs", "running", "runner", "jog", "jogging", "marathon", "interval",
        "tempo", "periodization", "vo2max", "vo2 max", "lactate threshold", "endurance", "aerobic", "anaerobic", "strength",
        "resistance training", "plyometric", "cardio", "conditioning", "warm-up", "cooldown", "mileage", "pace",
    ],
    "recovery": [
        "恢复", "睡眠", "休息", "拉伸", "放松", "按摩", "疲劳", "过度训练", "肌肉酸痛", "冷疗", "冰浴", "心率变异", "静息心率", "recovery", "sleep",
        "sleeping", "rest", "overtraining", "stretching", "mobility", "foam roll", "doms", "soreness", "hrv", "cold plunge",
    ],
    "injury": [
        "伤病", "损伤", "膝", "跟腱", "足底筋膜", "胫骨", "髂胫束", "拉伤", "疼痛", "康复", "预防", "跑步膝", "扭伤", "injury", "injuries", "tendon",
        "achilles", "plantar", "itbs", "shin splint", "rehab", "rehabilitation", "prevention", "sprain", "strain",
        "stress fracture", "patellofemoral",
    ],
    "nutrition": [
        "营养", "饮食", "蛋白", "碳水", "补剂", "电解质", "水分", "补给", "肌酸", "咖啡因", "减脂", "热量", "膳食", "nutrition", "diet", "protein",
        "carb", "carbohydrate", "hydration", "electrolyte", "creatine", "caffeine", "supplement", "calorie", "calories",
        "fueling", "glycogen", "macronutrient",
    ],
    "health": [
        "心率", "血压", "血糖", "体脂", "心脏", "健康", "体检", "代谢", "免疫", "骨密度", "慢性病", "心血管", "heart rate", "blood pressure",
        "body fat", "metabolic", "health", "cardiovascular", "cholesterol", "diabetes", "hypertension", "bone density",
        "immune", "wellness", "sedentary",
    ],
    "weight_loss": [
        "减重", "减肥", "体重", "瘦身", "热量缺口", "基础代谢", "肥胖", "weight loss", "losing weight", "body weight", "bodyweight",
        "caloric deficit", "bmi", "obesity", "energy balance",
    ],
}

# Evidence level -> phrases, in order; then hosts that count as reviews.
EVIDENCE = [
    ("guideline", ["指南", "guideline", "recommendation", "position stand", "共识"]),
    ("review", ["systematic review", "meta-analysis", "系统评价", "荟萃分析"]),
    ("rct", ["randomized", "randomised", "对照试验", "rct", "clinical trial"]),
]
REVIEW_HOSTS = ["pubmed", "ncbi", "bmj", "cochrane", "springeropen"]

# Weights of authority, recency and relevance; half-life in days; hits that saturate relevance; thresholds.
W_DOMAIN, W_RECENCY, W_RELEVANCE = 0.55, 0.20, 0.25
HALF_LIFE_DAYS = 900
SATURATION = 12
MIN_RELEVANCE = 0.25
MIN_BODY = 300
INDEX_SHARE = 0.80
CLASSIFY_CHARS = 20_000
PROSE_CHARS, PROSE_LINK_SHARE, LINE_LINK_SHARE = 120, 0.35, 0.40

# Patterns of links, of titles that are institutional news, and of footers.
LINK = r"\[[^\]]{0,120}\]\([^)\s]{0,300}\)"
NEWS = (
    "会议|大会|召开|举办|开班|座谈|研讨|交流|论坛|峰会|沙龙|讲座|报告会|调研|视察|考察|来访|访问|签署|签约|揭牌|启动仪式|动员|换届|述职|"
    "表彰|颁奖|联欢|党日|党建|党课|主题教育|巡视|督查|通报|公示|公告|通知|中标|成交|招标|采购|询价|招聘|任免|聘期|培训班|研修班|学习班|征文|征稿|"
    "申报|评审结果|评审通知|年检|备案|注销|资产处置|决算|预算|审计|工作动态|工作纪实|活动纪实"
)
FOOTER = (
    "友情链接|相关链接|相关阅读|推荐阅读|热门推荐|延伸阅读|更多阅读|站点地图|网站地图|联系我们|关于我们|版权声明|版权所有|网站声明|"
    "法律声明|隐私政策|免责声明|特别声明|主办单位|承办单位|技术支持|ICP备|地址[:：]|邮编[:：]|电话[:：]|传真[:：]|"
    "related (links?|articles?|posts?|reading|content)|quick links|follow us|subscribe|newsletter|site ?map|contact us|about us|"
    "privacy policy|terms of use|disclaimer|copyright|all rights reserved|you might also like|recommended (for you|reading)|share this"
)
NOISE_HEADING = (
    r"^#{1,4}\s*\[?\s*(references?|sources?|citations?|bibliography|external links?|further reading|related (articles|posts|reading)|still have questions|"
    r"about (our|the) editorial team|参考文献|参考资料|参考来源|相关阅读|延伸阅读|编辑团队)\s*\]?\s*[:：]?\s*$"
)

# Parts of paths that are no articles, file types, section names, shops; and signs of articles with their scores.
SKIP_PART = (
    "tag|tags|category|categories|author|authors|about|contact|login|log-in|signin|register|sign-up|search|rss|feed|sitemap|privacy|terms|cookie|legal|"
    "membership|join|donate|donation|store|shop|cart|checkout|account|careers|jobs|press|media-kit|advertise|newsletter|subscribe|"
    "events?|meetings?|conference|webinar|foundation|sponsor|partners?|certification|certifications|education-resources|resource-library|"
    "advocacy|archive|faqs?|help|support|leadership|governance|视频|图片|下载|招聘|广告|关于|联系|登录|注册|搜索"
)
SKIP_TYPE = r"\.(jpg|jpeg|png|gif|svg|webp|ico|pdf|zip|rar|mp4|mp3|wav|css|js|json|xml|docx?|xlsx?|pptx?)$"
SECTION = r"^(index|default|list|main|home|more|site|all)$"
SHOP = r"/(best-|mattress|pillow|bedding|deals?|coupons?|discount|shop|buy|product)s?/"
PAGE_TYPE = r"\.(html?|shtml|php|aspx?|jsp)$"
ARTICLE_PARTS = ["/article", "/news", "/blog/", "/post", "/detail", "/content"]
ARTICLE_SIGNS = [(r"/c\d{4,}/content\.html?$", 6), (r"/art/", 6), (r"/t\d+_\d+\.html?$", 5), (r"/\d{4}[/-]\d{1,2}", 4), (r"/(?:content|detail|article|news|post)s?/", 3)]
TRACKING = ["utm_", "spm", "from", "share"]

# Elements dropped with their content, elements that end a line, and entities.
DROPPED_TAGS = ["script", "style", "nav", "header", "footer", "aside", "form", "noscript"]
BLOCK_TAGS = "p|div|h[1-6]|li|tr|section|article|br"
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "nbsp": " ", "copy": "©", "middot": "·", "hellip": "…", "mdash": "—", "ndash": "–", "amp": "&"}

# Words that are no query terms.
STOP = (
    "我 你 他 她 它 的 了 是 在 和 与 或 有 没 不 很 太 都 也 还 就 要 会 能 可以 怎么 如何 什么 为什么 哪些 哪个 这个 那个 这样 那样 应该 需 需要 想 请 帮 "
    "一下 一些 时候 现在 最近 今天 昨天 明天 吗 呢 啊 吧 嘛 the a an of to in for and or is are be do does how what why which i my me you your"
).split()

#: Hosts whose pages are previews, galleries or directories; a result of a host that holds one of these is left out.
BLOCKED_HOSTS = [
    "docin.com", "book118.com", "wenku.baidu.com", "zxxk.com", "doc88.com",
    "360doc.com", "doc88.net", "51wendang.com", "renrendoc.com", "taodocs.com",
    "mayiwenku.com", "jinchutou.com", "xueshu.baidu.com", "doczj.com", "nipic.com",
    "528045.com", "zhipin.com", "qcc.com", "aiqicha.baidu.com", "zhaopin.com", "qichamao.com",
]
#: The categories an article may have.
CATEGORIES = list(TOPICS)

#: Names of dates in a page's metadata, in order; separator of points; goals whose plans ask for food too, and the words that
#: are searched for then.
DATE_META = ["published_time", "article:published_time", "date", "pubdate", "og:published_time"]
POINT_SEPARATOR = "；"
DIET_GOALS = ["fat_loss", "weight_loss"]
DIET_TERMS = "减脂饮食 营养搭配 食材热量"
PLAN_TERMS = "跑步训练 计划 心率区间"
