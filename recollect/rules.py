"""Fixed values of the rule sets, stated plainly.

Everything here is data: word lists, phrase lists and small lookup tables whose
content decides results.  Order matters where a list is described as ordered.
The logic that applies them lives in ``functions/``.
"""

# --- privacy -----------------------------------------------------------------
# A window whose title or app holds one of these is never kept.
PRIVATE_WINDOW_MARKERS = [
    "metamask", "phantom wallet", "trust wallet", "tonkeeper", "exodus wallet",
    "ledger live", "trezor", "seed phrase", "recovery phrase", "secret phrase",
    "private key", "1password", "bitwarden", "lastpass", "keepass", "dashlane",
    "nordpass", "password manager", "sign in", "log in", "password",
    "online banking", "kaspi", "halyk", "sberbank",
]
# Titles holding one of these are dropped before processing.
TITLE_BLACKLIST = [
    "bank", "crypto", "login", "password", "incognito", "private browsing",
    "1password", "bitwarden", "keepass", "lastpass", "dashlane",
]
# Chat apps, and the title words that make a chat worth keeping.
MESSENGER_APPS = [
    "telegram", "discord", "slack", "whatsapp", "viber", "vk", "vkontakte",
    "messenger", "signal", "skype", "zoom", "teams", "element", "matrix",
]
WORK_TITLE_WORDS = [
    "task", "deploy", "bug", "release", "pr ", "pull request", "merge",
    "issue", "urgent", "meeting", "deadline",
]
# Credential prefixes, compared without case.
TOKEN_PREFIXES = [
    "sk-", "sk_", "pk_", "rk_", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_",
    "xox", "akey-", "akia", "asia", "ya29.", "aiza", "eyj",
]
# Limits and marks of the redaction.
TOKEN_MIN_BYTES = 20
HEX_MIN_CHARS = 48
EVM_HEX_MIN_CHARS = 40
CARD_MIN_DIGITS = 13
CARD_MAX_DIGITS = 19
SEED_RUN_MIN_WORDS = 12
KEY_MARK = "[key redacted]"
CARD_MARK = "[card redacted]"
SEED_MARK = "[seed phrase redacted]"
SEAL_MARK = "enc1:"
CLIPBOARD_MIN_BYTES = 10
# Fixed values, ordered: a log line is cut after the first of these it holds.
LOG_CONTENT_MARKERS = [
    "search: ", "search for ", "ytdl: ", "play by name: ", "MEDIA_PLAY",
    "YT_SEARCH", "WEB_SEARCH", "fallback → ",
]

# --- applications ------------------------------------------------------------
BROWSERS = ["firefox", "chrome", "edge", "opera", "yandex", "brave", "chromium",
            "safari", "mozilla"]
EDITORS = ["visual studio code", "vs code", "code", "intellij", "pycharm", "clion",
           "webstorm", "rider", "sublime", "notepad++", "zed"]
# Fixed values, ordered: site needle -> label.
KNOWN_SITES = [
    ("youtube", "YouTube"), ("youtu.be", "YouTube"), ("wikipedia", "Wikipedia"),
    ("github", "GitHub"), ("reddit", "Reddit"), ("twitch", "Twitch"),
    ("vk.com", "VK"), ("telegram", "Telegram"), ("stack overflow", "Stack Overflow"),
    ("habr", "Habr"), ("netflix", "Netflix"), ("soundcloud", "SoundCloud"),
    ("spotify", "Spotify"),
]
VIDEO_SITES = ["youtube", "youtu.be", "twitch", "netflix", "rutube"]
MUSIC_SITES = ["soundcloud", "spotify", "apple music"]
CHAT_SITES = ["telegram", "discord", "whatsapp", "vk.com", "slack"]
SEPARATORS = [" — ", " – ", " - ", " | "]
# Application groups and limits of the frame rules.
NON_SCREEN_APPS = ["clipboard", "system", "user"]
NON_ACTIVITY_APPS = ["dialogue", "qa", "note"]
SUMMARY_SKIP_APPS = ["clipboard", "system", "analyst", "user", "dialogue"]
TIGHT_HASH_APPS = ["code", "cursor", "windowsterminal", "nvim", "vim", "idea", "rider"]
TIGHT_HASH_BITS = 2
LOOSE_HASH_BITS = 5
BLOCK_CHANGED_BITS = 5
DIRTY_RATIO_MIN = 0.05
LINK_SIMILARITY = 0.90
# File stems of games, and signs of an anti-cheat in a path.
GAME_EXES = [
    "valorant-win64-shipping", "valorant", "csgo", "cs2", "league of legends",
    "leagueoflegends", "riotclientservices", "fortniteclient-win64-shipping",
    "r5apex", "r5apex_dx12", "destiny2", "rainbowsix", "rainbowsix_vulkan",
    "tslgame", "dota2", "overwatch", "modernwarfare", "cod", "bo6", "eldenring",
]
ANTICHEAT_HINTS = ["vanguard", "vgtray", "vgc", "easyanticheat", "\\eac\\",
                   "battleye", "beservice", "punkbuster", "faceit"]
# Fixed values, ordered: default service dimension (id, label, kind, aliases).
SERVICES = [
    ("soundcloud", "SoundCloud", "audio", ["soundcloud"]),
    ("spotify", "Spotify", "audio", ["spotify"]),
    ("yandex_music", "Yandex Music", "audio", ["apple music", "music.apple"]),
    ("youtube_music", "YouTube Music", "audio", ["music.youtube", "youtube music"]),
    ("youtube", "YouTube", "both", ["youtube", "youtu.be"]),
    ("twitch", "Twitch", "video", ["twitch"]),
    ("netflix", "Netflix", "video", ["netflix"]),
    ("kinopoisk", "Kinopoisk", "video", ["primevideo", "prime video"]),
    ("ivi", "ivi", "video", ["hbo", "hbomax", "max.com"]),
]

# --- tags --------------------------------------------------------------------
# Fixed values, ordered: tag, words sought in the text, words sought in app/title.
_FINANCE = ["bank", "payment", "invoice", "salary", "tax", "card", "wallet",
            "trading", "binance", "paypal", "stripe"]
_FUN = ["youtube", "twitch", "netflix", "spotify", "steam", "game", "movie",
        "series", "music", "podcast", "tiktok", "instagram", "vk.com", "vkvideo"]
TAG_RULES = [
    ("#code",
     ["fn ", "pub ", "impl ", "struct ", "class ", "def ", "import ", "return ",
      "let ", "const ", "async ", "await ", "cargo", "npm", "git ", "docker",
      "kubectl", "pip ", "error[", "warning[", "traceback", "exception", "panic",
      "stack trace"],
     ["code", "terminal", "cmd", "powershell", "vim", "neovim", "rider", "intellij",
      "pycharm", "clion", "webstorm", "xcode", "cursor", "zed", "notepad++", "sublime"]),
    ("#work",
     ["excel", "word", "outlook", "teams", "meeting", "deadline", "invoice", "task",
      "sprint", "standup", "jira", "trello", "confluence", "notion", "slack", "zoom",
      "google meet"],
     ["excel", "word", "outlook", "teams", "notion", "jira", "confluence", "trello",
      "asana", "linear"]),
    ("#finance", _FINANCE, _FINANCE),
    ("#entertainment", _FUN, _FUN),
]

# --- code skeletons ----------------------------------------------------------
CODE_HINTS = ["fn ", "pub ", "impl ", "struct ", "enum ", "def ", "class ", "function "]
CODE_KEEP_PREFIXES = ["///", "//!", "pub ", "fn ", "async fn", "impl ", "struct ",
                      "enum ", "type ", "trait ", "use ", "mod ", "const ", "static ",
                      "#[", "where "]

# --- questions ---------------------------------------------------------------
RECALL_PHRASES = [
    "what did i do", "what did i", "what was i doing", "what was i just",
    "what have i been doing", "what have i done", "what i did", "what i was doing",
    "what i've been doing", "what ive been doing", "what did i open",
    "what did i watch", "what did i read", "what did i launch", "what was i up to",
    "what have i been up to", "what am i doing", "what was i working on",
    "what have i been working on", "what did i work on", "which apps",
    "which programs", "what apps", "what programs", "what happened",
    "what was on screen", "what was on the screen", "my activity",
    "my recent activity", "recent activity", "my day", "my week", "my session",
    "my timeline", "my history", "catch me up", "remind me what", "show me what i",
]
SCREEN_PHRASES = [
    "on my screen", "on screen", "my screen", "this window", "the window",
    "current window", "in front of me", "what am i looking at", "what's open",
    "whats open", "what is open", "which window",
]
SCREEN_ACTIVITY_WORDS = ["youtube", "video", "browser", "site", "tab", "watching",
                         "reading", "playing"]
SCREEN_SELF_WORDS = ["i", "im", "me", "my", "mine"]
SCREEN_OPEN_CUES = ["open", "opened", "running"]
NAME_QUESTIONS_EXACT = ["who am i", "do you know who i am", "do you know my name"]
NAME_QUESTIONS = ["what is my name", "what's my name", "whats my name", "tell me my name"]
IDENTITY_QUESTIONS_EXACT = ["who are you", "what are you", "who r u"]
IDENTITY_QUESTIONS = ["what is your name", "what's your name", "whats your name",
                      "tell me your name"]
# Phrases that decide about a web search.
WEB_REFUSED = ["don't search", "do not search", "no internet", "without internet",
               "offline", "locally", "local only"]
WEB_LOCAL_ONLY = [
    "who are you", "what are you", "your name", "what can you do",
    "tell me about yourself", "what do you do", "remind", "my screen", "my terminal",
    "on my system", "my version", "what's the meaning", "explain", "how does",
    "how do i", "write ", "generate", "create a", "help me", "example of", "how to",
    "calculate", "solve", "compute",
]
WEB_WANTED = [
    "openai", "tesla", "apple", "nvidia", "spacex", "news", "today", "latest",
    "right now", "current", "weather", "forecast", "price", "cost", "how much",
    "stock", "bitcoin", "crypto", "currency", "exchange rate", "net worth",
    "population", "how many people", "record", "world record", "who is", "who was",
    "who wrote", "who created", "who invented", "who founded", "when did", "when was",
    "when born", "when died", "what year", "biography", "founded in", "year founded",
    "search", "google", "look up", "on the internet", "search the web",
]
# Phrases of the question rules about secrets and reports.
SECRET_WORDS = [
    "seed phrase", "recovery phrase", "recovery words", "mnemonic", "private key",
    "private keys", "api key", "api keys", "secret key", "password", "passwords",
    "card number", "card numbers", "credit card", "bank card", "cvv", "wallet",
]
SECRET_ABOUT_STORE = [
    "my ", "you saw", "you have", "you see", "you seen", "you know", "your memory",
    "in memory", "stored", "did you", "do you", "have you", "show me", "list any",
    "what passwords",
]
REPORT_VERBS = [
    "write a report", "write a summary", "make a report", "create a report",
    "write me a report", "write up my", "report on what i", "summarize my week",
    "summarise my week", "summarize my day", "write a doc", "save a report",
]
# Words that may open a question, with a comma after them where one can stand.
OPENERS = ["hi,", "hey,", "hello,", "ok,", "okay,", "so,", "btw,", "yo", "and"]
# Leads and stop words of the subject rules.
PERSON_LEADS = ["who is ", "who was ", "who's ", "who are ", "who were "]
PERSON_STOP_FIRST = ["he", "she", "they", "it", "i", "you", "we", "the", "a", "an",
                     "my", "your", "his", "her", "their", "this", "that"]
ABOUT_LEADS = [
    "tell me more about ", "tell me about ", "tell about ", "tell me smth about ",
    "what do you know about ", "what can you tell me about ", "do you know about ",
    "info about ", "information about ",
]
ABOUT_STOP_FIRST = [
    "you", "u", "yourself", "urself", "your", "ur", "yours", "me", "myself", "my",
    "mine", "us", "our", "we", "him", "his", "her", "hers", "them", "their", "they",
    "it", "its", "this", "that",
]
FACT_LEADS = [
    "what is", "what was", "what's", "what are", "who invented", "who discovered",
    "who won", "who wrote", "who created", "explain", "describe", "define",
    "when was", "when did", "where is", "where was",
]
# Leads and tails of the statement rules.
RENAME_LEADS = ["his nickname is ", "her nickname is ", "his name is ",
                "her name is ", "his nick is ", "her nick is "]
CLARIFY_LEADS = ["i mean ", "i meant ", "i'm talking about ", "im talking about ",
                 "i am talking about ", "i am about ", "i'm about "]
DESCRIBE_LEADS = ["he is ", "she is ", "they are ", "he's ", "she's "]
COMMAND_TAILS = [
    " find him", " find her", " find them", " find it", " find this", " search him",
    " search her", " search them", " search for him", " search for her",
    " search for them", " look him up", " look her up", " look them up",
    " look it up", " google him", " google her", " google them", " google it",
    " look for him", " look for her", " look for them",
]
DANGLING_WORDS = ["and", "then", "so", "now", "also", "plus", "please"]
# Words that refer back.
REFERENCE_WORDS = ["it", "its", "that", "this", "these", "those", "they", "them",
                   "their", "there", "he", "she", "his", "her", "more"]
FOLLOWUP_STARTS = ["how ", "is he", "is she", "was he", "was she", "does he",
                   "does she", "did he", "did she", "what does he", "where is he",
                   "when did he"]
THIRD_PERSON_CUES = ["he ", "she ", " he", " she", "his ", "her ", "him", "them", "their"]
# Words that make a question current or local.
FORCE_ONLINE = ["openai", "news", "today", "latest", "weather", "price"]
LOCATION_WORDS = ["weather", "forecast", "traffic", "news"]

# --- back references ---------------------------------------------------------
COMMAND_STARTS = ["open ", "show ", "launch ", "run ", "start ", "go to ", "play ",
                  "put on ", "watch ", "turn on ", "turn ", "search ", "find ",
                  "google ", "look up "]
POSSESSIVES = ["his", "her", "its", "their"]
CONNECTORS = ["about", "of", "by", "from", "with"]
PRONOUNS = ["him", "her", "them", "it", "his", "its", "their", "this", "that"]
WEAK_PRONOUNS = ["it", "this", "that"]
REFERENT_LEADS = [
    "who is ", "who was ", "who's ", "who are ", "who were ", "what is ", "what was ",
    "what's ", "what are ", "tell me more about ", "tell me about ", "tell about ",
    "explain ", "describe ", "define ",
]
REFERENT_TAIL_WORDS = ["mean", "means", "like"]
NON_ENTITY_FIRST = ["i", "you", "he", "she", "we", "they", "it", "me", "my", "your",
                    "his", "her", "our", "their", "this", "that", "these", "those"]

# --- numbers and dates -------------------------------------------------------
# Spelling -> month code.
MONTHS = {
    "january": "jan", "february": "feb", "march": "mar", "april": "apr", "june": "jun",
    "july": "jul", "august": "aug", "september": "sep", "october": "oct",
    "november": "nov", "december": "dec", "jan": "jan", "feb": "feb", "mar": "mar",
    "apr": "apr", "may": "may", "jun": "jun", "jul": "jul", "aug": "aug",
    "sept": "sep", "sep": "sep", "oct": "oct", "nov": "nov", "dec": "dec",
}

# --- sentences shown to a reader, in this library's own words -----------------
NOTHING_FOUND = "[no matching records]"
NO_MATCH_LINE = "No answer arrived; ask once more."
NOTICE_UNVERIFIED = "[unchecked figures] The sources do not hold some numbers of the answer. Matching lines:"
CAVEAT = "[no source] Nothing stored or found on the web supports this answer; it may be wrong."
SKIP_ANSWER_START = "[unchecked figures]"
MIN_ANSWER_BYTES = 20

# --- places ------------------------------------------------------------------
# System time-zone name -> city.
CITY_BY_ZONE = {
    "Russian Standard Time": "Moscow", "Russian Time Zone 1": "Samara",
    "Ekaterinburg Standard Time": "Yekaterinburg",
    "N. Central Asia Standard Time": "Omsk", "Central Asia Standard Time": "Almaty",
    "Kazakhstan Standard Time": "Astana", "North Asia Standard Time": "Krasnoyarsk",
    "North Asia East Standard Time": "Irkutsk", "Transbaikal Standard Time": "Chita",
    "Yakutsk Standard Time": "Yakutsk", "Vladivostok Standard Time": "Vladivostok",
    "Russia Time Zone 10": "Magadan", "Russia Time Zone 11": "Petropavlovsk-Kamchatsky",
    "FLE Standard Time": "Kyiv", "Ukraine Standard Time": "Kyiv",
    "Belarus Standard Time": "Minsk", "Azerbaijan Standard Time": "Baku",
    "Georgian Standard Time": "Tbilisi", "Armenian Standard Time": "Yerevan",
    "Uzbekistan Standard Time": "Tashkent", "Kyrgyzstan Standard Time": "Bishkek",
    "Tajikistan Standard Time": "Dushanbe", "Turkmenistan Standard Time": "Ashgabat",
    "GMT Standard Time": "London", "W. Europe Standard Time": "Berlin",
    "Central European Standard Time": "Warsaw", "Central Europe Standard Time": "Prague",
    "Romance Standard Time": "Paris", "Turkey Standard Time": "Istanbul",
    "Israel Standard Time": "Tel Aviv", "Arabian Standard Time": "Dubai",
    "Arab Standard Time": "Riyadh", "India Standard Time": "Delhi",
    "China Standard Time": "Beijing", "Tokyo Standard Time": "Tokyo",
    "Korea Standard Time": "Seoul", "Singapore Standard Time": "Singapore",
    "Eastern Standard Time": "New York", "Central Standard Time": "Chicago",
    "Mountain Standard Time": "Denver", "Pacific Standard Time": "Los Angeles",
    "E. South America Standard Time": "Sao Paulo", "E. Africa Standard Time": "Nairobi",
    "South Africa Standard Time": "Johannesburg",
}
