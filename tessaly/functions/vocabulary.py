"""Phrases and limits that decide results. Kept as plain text, in order."""

# Closing phrases of presentations.
CLOSING_TERMS = (
    "本讲结束", "本节结束", "课程结束", "欢迎提问", "谢谢观看", "谢谢聆听", "感谢聆听", "感谢观看",
    "thank you", "thanks", "questions", "q&a",
)

# Contents pages.
OUTLINE_TERMS = ("目录", "contents", "目 录")

# Publication data and prefaces.
FRONT_MATTER_TERMS = (
    "版权所有", "copyright", "出版社", "出版发行", "出版者", "出版日期", "印刷", "印次",
    "isbn", "cip", "图书在版编目", "责任编辑", "装帧设计", "定价", "版次", "编著", "主编",
    "译者", "作者简介", "内容简介", "preface", "foreword", "前言", "序言", "序 ",
)
METADATA_MARKERS = ("ISBN", "Copyright", "版权所有")
TEACHING_SIGNAL = r"(?i)第\s*[一二三四五六七八九十0-9]+\s*章|chapter\s*\d|定义|定理|函数|算法|实验"

# Headings.
CHAPTER_LINE = r"(?i)^(?:第\s*[一二三四五六七八九十百零〇0-9]+\s*章\s*.*|chapter\s+\d+\b.*)$"
CHAPTER_NUMBER = r"^第\s*([〇一二三四五六七八九十百零0-9]+)\s*章"
ANSWER_KEY_MARKERS = (
    "习题答案", "参考答案", "习题解答", "自测题", "答案与提示",
    "exercise answers", "exercises answers", "answer key", "solutions",
)
MAJOR_SECTION = r"^\s*(\d+)\.(\d+)(?!\.)\s*(.*)$"
SUBSECTION = r"^\s*(\d+)\.(\d+)\.\d+\s*(.*)$"
NUMBERED_EXERCISE = r"^\s*习题\s*(\d+)\.(\d+)\s*$"
CHAPTER_EXERCISE = r"^\s*习题\s*[一二三四五六七八九十百\d]+\s*$"

# Paper markers.
PAPER_MARKERS = ("abstract", "introduction", "related work", "references")

# Planning text.
PLAN_KEYWORDS = ("截止", "优先", "复盘", "上午", "下午", "晚上", "子任务", "时间")
TOP_PRIORITY = ("高优先级", "最高优先级")
WEEKDAYS = (("周一", 0), ("周二", 1), ("周三", 2), ("周四", 3), ("周五", 4), ("周六", 5), ("周日", 6), ("周天", 6))
TITLE_PREFIX = r"^(我|我们)?(这周|本周|今天|近期)?(要|需要|准备|计划)?"
TITLE_NOISE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}，。！？、,:：;；]+"

# Preferences.
DIET_WORD = "饮食"
DIET_LABELS = ("饮食偏好：", "饮食偏好:")
NO_SPICE_WORDS = ("不吃辣", "不要辣")
SPICE_WORDS = ("喜欢辣", "想吃辣")
BUDGET_PATTERN = r"(?:预算|以内|不超过)[^\d]{0,8}(\d{1,3})"
AVOID_PATTERN = r"(?:不吃|不要|别推荐|忌口)\s*([^，。；,;]+)"
LIKE_PATTERN = r"(?:喜欢|偏好)\s*([^，。；,;]+)"

# Transient failures.
RETRYABLE_MARKERS = (
    "timeout", "timed out", "connection reset", "connection aborted", "temporarily unavailable",
    "http 429", "http 500", "http 502", "http 503", "http 504", "拒绝访问",
)
ACTIVE_STATUSES = ("queued", "running", "retry_wait", "cancelling")
STALE_SECONDS = 75
REFRESH_DAYS = 7

# Node titles by action.
ACTION_TITLES = {
    "explain": "解释这一步",
    "example": "举一个例子",
    "solve": "提问与解题",
    "variable": "变量含义",
    "why": "为什么",
    "question": "自定义提问",
    "paper_summary": "5 分钟速读",
    "note": "阅读笔记",
}

# Sizes.
INDEX_CHUNK, INDEX_OVERLAP = 1200, 180
PAGE_CHUNK = 6500
PART_LIMIT = 4500
PLANNING_LIMIT = 52000
