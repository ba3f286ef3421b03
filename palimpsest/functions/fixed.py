"""Word lists, tables and thresholds that results depend on."""

#: Letters of other scripts that look like Latin ones.
CONFUSABLES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ρ": "p",
}

#: Digits that stand for capital letters inside words.
DIGIT_LETTERS = {"0": "O", "1": "I", "3": "E", "4": "A", "5": "S", "7": "T", "8": "B"}

#: Traces of program or markup source.
SOURCE_MARKERS = ("<!--", "-->", "</", "<script", "function ", "var ", "let ", "const ", "document.", "getelementbyid", "=>", "{", "}", ";")

#: Compatibility jamo in the order of the syllable formula.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"

#: Zero-width and bidirectional controls.
INVISIBLE = "\u200b\u200c\u200d\u2060\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"

#: Places of a page's own furniture: for the landmark penalty, and for the open-set one.
LANDMARKS = ("dialog", "modal", "nav", "header", "footer", "menu")
FURNITURE = ("dialog", "modal", "nav", "header", "footer", "menu", "cookie", "tooltip", "drawer")
MENU_LABEL = r"(?:menu|navigation|breadcrumb|pagination|메뉴|내비게이션)(?:\s+(?:guide|label|안내))?"
VERSION_LABEL = r"(?:version|ver\.?|버전)\s*[v.]?\s*\d+(?:\.\d+)*"

#: Static files, which aren't pages.
STATIC_EXTENSIONS = (
    ".7z", ".atom", ".avi", ".css", ".csv", ".doc", ".docx", ".gif", ".gz", ".ico", ".jpeg", ".jpg", ".js", ".json", ".mov", ".mp3",
    ".mp4", ".pdf", ".png", ".ppt", ".pptx", ".rar", ".rss", ".svg", ".tar", ".webm", ".webp", ".xls", ".xlsx", ".xml", ".zip",
)
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")
TRACKING_PREFIX, CHALLENGE_PREFIX = "utm_", "__cf_chl_"
DYNAMIC_GROUPS = ("article", "articles", "board", "boards", "character", "characters", "gallery", "post", "posts", "series", "tag", "tags")
SOURCE_RANK = {"entry": 0, "browser": 0, "http": 1, "sitemap": 3}
TRANSIENT_ERRORS = ("execution context was destroyed", "interrupted by another navigation", "net::err_aborted", "frame was detached", "navigation interrupted")

#: Brands, their aliases and their official domains, in order of precedence.
BRANDS = (
    ("Facebook", ("facebook", "페이스북"), ("facebook.com", "fb.com")),
    ("Twitch", ("twitch", "트위치"), ("twitch.tv",)),
    ("Instagram", ("instagram", "인스타그램"), ("instagram.com",)),
    ("Google", ("google", "구글"), ("google.com",)),
    ("Microsoft", ("microsoft", "마이크로소프트"), ("microsoft.com",)),
    ("Apple", ("apple", "애플"), ("apple.com",)),
    ("Naver", ("naver", "네이버"), ("naver.com",)),
    ("Kakao", ("kakao", "카카오"), ("kakao.com",)),
    ("PayPal", ("paypal", "페이팔"), ("paypal.com",)),
    ("Netflix", ("netflix", "넷플릭스"), ("netflix.com",)),
    ("Amazon", ("amazon", "아마존"), ("amazon.com",)),
    ("Discord", ("discord", "디스코드"), ("discord.com",)),
    ("Telegram", ("telegram", "텔레그램"), ("telegram.org",)),
    ("Coupang", ("coupang", "쿠팡"), ("coupang.com",)),
)
SECOND_LEVEL = ("co.kr", "or.kr", "go.kr", "ac.kr", "co.uk", "org.uk", "com.au", "com.br", "co.jp")

#: Letters and digits that look like ASCII letters in host names.
HOST_CONFUSABLES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "υ": "y",
    "0": "o", "1": "l", "3": "e", "5": "s", "7": "t",
}

#: Words that mark unlawful advertising by themselves, and those that need more.
CORE_WORDS = ("카지노", "토토", "슬롯", "바카라", "베팅", "배팅", "먹튀", "첫충", "환전", "출금", "충전", "사설", "놀이터", "배당", "가입코드", "casino", "betting", "slot", "adult", "성인", "19금")
CONTEXT_WORDS = ("텔레그램", "telegram")

TECHNIQUES = ("TRANSPARENT", "OFFSCREEN", "JAMO", "HOMOGLYPH")
PASSES = ("desktop-initial", "desktop-settled", "desktop-scrolled", "mobile-settled", "mobile-scrolled")
