"""Fixed values.

Everything in this module is a word list, lookup table, pattern, format or
constant whose value decides the result of an operator.  They are kept here as
plain text, together, in their natural order; the logic that uses them lives in
the other modules.
"""

# --- URLs: fixed values -----------------------------------------------------

TRACKING_NAMES = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "_bhlid", "ref", "source", "mc_cid", "mc_eid", "fbclid", "gclid",
    "msclkid", "twclid", "igshid", "s", "si",
]

TRACKING_PREFIXES = [
    "utm_", "ref", "source", "campaign", "medium", "fbclid", "gclid",
    "mc_", "ml_", "_ga", "_gl", "sref", "smid", "unlocked_article_code",
]

# Substrings that mark a newsletter link as internal.
INTERNAL_MARKS = [
    "beehiiv.com/subscribe", "beehiiv.com/login", "/subscribe", "/share",
    "twitter.com/intent", "facebook.com/sharer", "linkedin.com/share",
    "threads.net/intent", "mailto:", "#",
]

# The shorter variant used while walking digest newsletters.
INTERNAL_MARKS_DIGEST = [
    "/subscribe", "/login", "/signup", "/share", "/auth",
    "twitter.com/intent", "facebook.com/sharer", "linkedin.com/share",
    "mailto:", "#", "javascript:",
]

REDIRECT_MARKS = ["links.beehiiv.com", "beehiiv.com/r/"]

VIDEO_HOSTS = ["youtube.com", "youtu.be"]
NEWSLETTER_HOSTS = [
    "execsum.co", "beehiiv.com", "substack.com", "mailchimp.com", "buttondown.email",
]
FEED_MARKS = [".rss", ".xml", "/feed", "/rss", "atom", "/feeds/"]
FEED_MARKS_ROUTING = [".rss", ".xml", "/feed", "/rss", "atom"]
NEWSLETTER_ROUTING_HOST = "beehiiv.com"
CHANNEL_HOST = "t.me"

ARCHIVE_PATH_PATTERN = r"/p/|/posts?/|/articles?/|/\d{4}/\d{2}/"


SOURCE_NAMES = {
    "reuters.com": "Reuters",
    "bloomberg.com": "Bloomberg",
    "ft.com": "Financial Times",
    "cnbc.com": "CNBC",
    "nytimes.com": "New York Times",
    "wsj.com": "Wall Street Journal",
    "economist.com": "The Economist",
    "awealthofcommonsense.com": "A Wealth of Common Sense",
}

SOURCE_ABBREVIATIONS = {
    "reuters.com": "RT",
    "bloomberg.com": "BBG",
    "ft.com": "FT",
    "cnbc.com": "CNBC",
    "nytimes.com": "NYT",
    "wsj.com": "WSJ",
    "economist.com": "ECON",
    "barrons.com": "BARR",
    "marketwatch.com": "MW",
    "awealthofcommonsense.com": "AWOC",
}

SPOKEN_SOURCE_NAMES = {
    "execsum.co": "Exec Sum",
    "bloomberg.com": "Bloomberg",
    "reuters.com": "Reuters",
    "wsj.com": "Wall Street Journal",
    "ft.com": "Financial Times",
    "cnbc.com": "CNBC",
}

HOST_RULE_SETS = {
    "execsum.co": "execsum",
    "cryptosum.beehiiv.com": "cryptosum",
    "rwa-world.beehiiv.com": "rwa-world",
}

# --- Markup: fixed values ---------------------------------------------------

VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
    "track", "wbr",
]
BOILERPLATE_TAGS = [
    "script", "style", "nav", "footer", "header", "aside", "iframe", "noscript", "form",
]
RELATED_MARKS = [
    "related", "recommended", "more-stories", "more-articles",
    "also-read", "you-may-like", "trending", "popular",
    "sidebar", "widget", "advertisement", "ad-container",
    "social-share", "comments", "newsletter", "subscribe",
]
CONTENT_CLASSES = [
    "article-content", "article-body", "post-content",
    "entry-content", "story-body", "article__body",
    "content-body", "main-content", "article-text",
]
CHARACTER_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&bull;", "•"),
    ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&#8217;", "’"), ("&#8211;", "–"),
    ("&amp;", "&"),
]

# --- Filters: fixed values --------------------------------------------------

CHART_TOPIC_PATTERNS = [
    r"\bchart\b.*\banalysis\b",
    r"\btechnical analysis\b",
    r"\bprice prediction\b",
    r"\bprice target\b",
    r"\bsupport and resistance\b",
    r"\btrading setup\b",
    r"\btrade setup\b",
    r"\btrading strategy\b",
    r"\bscalp(ing)?\b",
    r"\bbull(ish)? flag\b",
    r"\bbear(ish)? flag\b",
    r"\bhead and shoulders\b",
    r"\bwedge pattern\b",
    r"\brsi\b.*\bdivergence\b",
    r"\bfibonacci\b",
    r"\bElliott wave\b",
    r"\bmoving average\b",
    r"\bMACD\b",
    r"\bBollinger\b",
    r"\bichimoku\b",
    r"\bcandlestick\b",
    r"\border block\b",
    r"\bbreakout\b.*\btarget\b",
    r"\blong\b.*\bshort\b.*\btrade\b",
    r"\brisk.to.reward\b",
]
CHART_TOPIC_KEYWORDS = [
    "major move for", "pump incoming", "dump incoming", "buy now", "sell now",
    "exact target", "next target", "moon soon", "altcoin season", "altcoins to buy",
]
SUPPRESSED_SOURCES = ["realvision", "raoulpal"]
SUPPRESSED_TOPIC = r"\bsui\b"

NAV_WORDS = [
    "login", "signup", "subscribe", "menu", "home", "about",
    "contact", "faq", "terms", "privacy", "merch", "store",
    "consulting", "identifier", "404", "user", "share",
    "tweet", "follow", "like", "comment", "reply",
    "read more", "see more", "view all", "load more",
    "next", "previous", "back", "forward", "litquidity",
    "exec sum", "exec.sum", "execsum",
]
PROMO_PHRASES = [
    "message from", "a message from", "sponsored by", "presented by",
    "brought to you", "use code", "discount", "off any order",
    "shop now", "buy now", "click here", "learn more",
    "sign up", "join now", "get started", "free trial",
    "daily newsletter", "curates major news", "read by",
    "investment bankers", "institutional investors", "venture capitalists",
    "touch of memes", "silicon valley", "wall street to",
    "the new year means", "wardrobe overhaul", "don't stress",
    "machine washable", "performance fabric", "wrinkle resistant",
    "i legit love", "stop sacrificing", "comfort for style",
    "olarry", "tax advisory", "flat fee", "flat price", "book a free consultation",
    "proactive, year-round", "outgrown 'tax prep'", "zero cross-selling",
    "proven track record", "unlimited strategy", "pass-through complexity",
    "chasing down your cpa", "go beyond traditional tax",
    "enroll and save", "lifetime access to networking", "globally recognized certificate",
    "running the model and running the deal", "wharton online",
    "what we're watching this week", "earnings calendar",
]
SECTION_HEADERS = [
    "bankruptcy / restructuring",
    "ipo / direct listings",
    "ipos / direct listings",
    "fundraising / secondaries",
    "deal flow",
    "headline roundup",
    "ipo / direct listings / issuances / block trades",
]
STRONG_SECTIONS = ["markets", "headline roundup", "deal flow"]
OPEN_SECTIONS = ["markets"]

MARKET_WORDS = [
    "%", "bps", "ath", "all-time", "high", "low", "rally", "surge", "drop",
    "fell", "rose", "climb", "spread", "dollar", "gold", "silver", "stock",
    "s&p", "dow", "nasdaq", "index", "yield", "bond", "treasury", "bitcoin",
    "oil", "copper", "platinum", "palladium", "nickel", "iron", "commodity",
]
MARKET_SKIP_WORDS = ["subscribe", "click", "join", "autopilot", "litquidity", "beehiiv"]
MARKET_SOURCE = "ExecSum"
MARKET_STARTS = ["*Markets", "Markets"]
MARKET_ENDS = [
    "Earnings", "Prediction Markets", "Headline Roundup", "Deal Flow",
    "Before The Bell", "Exec's Picks", "Execs Picks", "*Markets",
]
ROUNDUP_START = "Headline Roundup"
ROUNDUP_ENDS = [
    "Deal Flow", "M&A", "VC", "IPO", "Funds", "Prediction Markets",
    "Meme Cleanser", "Exec's Picks", "Execs Picks", "Related Posts",
    "*Markets", "Markets",
]
ROUNDUP_SKIP_WORDS = [
    "subscribe", "click", "join", "autopilot", "litquidity",
    "beehiiv", "merch", "fundable", "here", "listen", "take a",
]
HEADLINE_SOURCE_PATTERN = (
    r"\([A-Z]{2,4}\)$|\(Bloomberg\)$|\(Reuters\)$|\(CNBC\)$|\(WSJ\)$|\(FT\)$"
)
HEADLINE_SUFFIXES = ["(BBG)", "(RT)", "(CNBC)", "(FT)", "(WSJ)", "(NYT)", "(NBC)", "(TC)"]
TRUNCATED_ENDINGS = ["...", "driving", "landmark"]
TRUNCATED_ENDINGS_DIGEST = ["...", "driving", "landmark", " after", " its"]

LINKED_SUFFIXES = [
    "(BBG)", "(RT)", "(CNBC)", "(FT)", "(WSJ)", "(NYT)", "(NBC)",
    "Bloomberg", "Reuters", "CNBC", "Financial Times", "Wall Street Journal",
]
LINKED_SKIP_PHRASES = [
    "here", "click", "read more", "learn more", "see more",
    "litney", "stav", "listen", "updated for", "source",
    "hear more", "all things considered", "grown up",
    "guide to", "paradox", "lessons from", "rise to",
    "fight", "Paralympics", "Formula 1", "ces speech",
    "path ahead", "middle east", "potential scotus",
]
SOURCE_ONLY_HEADLINES = [
    "bloomberg", "reuters", "cnbc", "wsj", "financial times",
    "wall street journal", "new york times", "nbc", "ft",
]
DIGEST_SKIP_PHRASES = [
    "middle east", "jensen huang's ces speech", "potential scotus",
    "path ahead for venezuela", "litney partners", "take a listen",
    "stavmarket", "updated for 202", "straight from the source",
    "schedule a demo", "hour well spent", "has built the universe",
    "managers with over", "collectively rely on", "stavtar",
    "connect to vendors", "manage their vendors",
]

SECTION_KEYWORDS = {
    "Headline Roundup": "Headline Roundup",
    "Deal Flow": "Deal Flow",
    "M&A": "M&A / Investments",
    "VC": "VC",
    "IPO": "IPO / Listings",
    "SPAC": "SPAC",
    "Debt": "Debt",
    "Bankruptcy": "Bankruptcy / Restructuring",
    "Funds": "Funds / Secondaries",
    "Exec's Picks": "Execs Picks",
    "Markets": "Markets",
}
TRAINING_SECTIONS = [
    "Markets", "Headline Roundup", "Deal Flow", "M&A", "VC",
    "IPO", "SPAC", "Debt", "Bankruptcy", "Funds", "Secondaries",
    "Exec's Picks", "Crypto Sum", "Meme Cleanser", "Prediction Markets",
]

RESEARCH_CATEGORIES = ["Venture Capital", "Launches"]
RESEARCH_EXCLUDED = [
    "extra reads", "extra read", "regulatory", "regulation",
    "cybersecurity", "security", "hacks", "legal", "enforcement",
]
RESEARCH_TERMS = ["Solana", "Starknet", "Tether", "USDT", "SOL"]

# --- Entities: fixed values -------------------------------------------------

NAME_ALIASES = {
    "btc": "bitcoin", "eth": "ethereum", "sol": "solana", "bnb": "binance",
    "xrp": "ripple", "ada": "cardano", "doge": "dogecoin", "dot": "polkadot",
    "matic": "polygon", "avax": "avalanche", "link": "chainlink", "uni": "uniswap",
    "aave": "aave", "mkr": "maker", "crv": "curve", "snx": "synthetix",
    "comp": "compound", "ftm": "fantom", "atom": "cosmos", "near": "near",
    "apt": "aptos", "arb": "arbitrum", "op": "optimism", "sui": "sui",
}
TICKER_NAMES = {
    "BTC": "Bitcoin", "ETH": "Ethereum", "SOL": "Solana",
    "XRP": "XRP", "ADA": "Cardano", "DOGE": "Dogecoin",
    "DOT": "Polkadot", "LINK": "Chainlink", "UNI": "Uniswap",
    "ARB": "Arbitrum", "OP": "Optimism", "MATIC": "Polygon",
    "AVAX": "Avalanche", "ATOM": "Cosmos", "NEAR": "NEAR",
    "APT": "Aptos", "SUI": "Sui", "TAO": "Bittensor",
    "USDT": "Tether", "USDC": "USDC",
}
KEYWORD_STOP_WORDS = [
    "The", "This", "That", "With", "From", "Into", "Over", "After",
    "Before", "About", "Through", "During", "Between", "Under",
    "Again", "Further", "Then", "Once", "Here", "There", "When",
    "Where", "Why", "How", "All", "Each", "Few", "More", "Most",
    "Other", "Some", "Such", "Only", "Own", "Same", "Than", "Too",
    "Very", "Just", "Should", "Now", "New", "CEO", "CTO", "CFO",
    "Million", "Billion", "Market", "Trading", "Price", "Token",
    "Crypto", "Blockchain", "Network", "Protocol", "Fund", "Report",
    "Investment", "Venture", "Capital", "Exchange", "Platform",
    "Rally", "Surge", "Drop", "Fall", "Rise", "Gain", "Loss",
    "Firm", "Startup", "Company", "Group", "Digital", "Global",
    "Sign", "Spot", "Read", "Join", "Click", "Share", "Follow",
    "Subscribe", "Contact", "Learn", "Watch", "Start", "Get",
    "Free", "Try", "Send", "Submit", "Enter", "Create", "Open",
    "Save", "Download", "Access", "View", "Check", "Find",
    "DeFi", "Defi", "DEFI", "NFT", "Nft", "DAO", "Dao",
    "DEX", "Dex", "CEX", "Cex", "AMM", "Amm", "TVL", "Tvl",
    "APY", "Apy", "APR", "Apr", "ATH", "Ath", "FUD", "Fud",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
    "Trump", "Biden", "Musk", "Elon", "Obama", "Powell", "Gensler",
    "Yellen", "Congress", "Senate", "Federal", "Reserve", "Government",
    "Daily", "Breaking", "Update", "Alert", "News", "Report",
    "Salvador", "America", "Latin",
]
KEYWORD_STOP_PHRASES = [
    "New York", "United States", "Wall Street", "White House",
    "Hong Kong", "San Francisco", "Los Angeles", "Abu Dhabi",
    "South Korea", "North America", "United Kingdom",
]
PHRASE_PATTERN = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
MIXED_CASE_PATTERN = r"\b([A-Za-z]*[A-Z][a-z]+[A-Z][a-zA-Z]*|[a-z]+[A-Z][a-zA-Z]+)\b"
MARKED_TICKER_PATTERN = r"[\$\(]([A-Z]{2,5})[\)\s]"
LEADING_WORD_PATTERN = r"\b([A-Z][a-z]{2,})\b"
TICKER_PATTERN = r"\b([A-Z]{2,5})\b"
KEYWORD_LIMIT = 7

LEGAL_SUFFIXES = [
    " s.l.", " ltd", " ltd.", " gmbh", " inc", " inc.", " corp", " corp.",
    " llc", " plc", " pte", " s.a.", " s.r.l", " b.v.", " n.v.", " a.g.",
    " co.", " company", " limited", " corporation", " d.o.o", " s.p.a.",
    " slugs", " gang", " bear", " bull", " punks", " apes", " club",
    " nft", " dao", " token", " coin",
]
NAME_FILLER_WORDS = ["the", "a", "an", "of", "and", "for", "in", "on", "to"]
MATCH_THRESHOLD = 0.7

SUBJECT_PATTERNS = [
    r"\b([A-Z][a-z]+(?:[A-Z][a-z]*)*)\s+(?:raises?|secures?|closes?|announces?|launches?|unveils?)\b",
    r"\b(?:startup|company|protocol|platform|exchange|wallet|project)\s+([A-Z][a-z]+(?:[A-Z][a-z]*)*)\b",
    r"\b([A-Z][a-z]+(?:[A-Z][a-z]*)*),?\s+(?:a|the)\s+(?:startup|company|protocol|platform)\b",
]
SUBJECT_REJECTED = ["the", "this", "that", "which", "their"]
ENTITY_PATTERNS = [
    r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\s+(?:Labs?|Protocol|Network|Finance|Capital|Ventures|Fund|Foundation|Exchange|Wallet|DAO)\b",
    r"\b([A-Z][a-z]+[A-Z][a-z]+(?:[A-Z][a-z]*)*)\b",
    r"\b([A-Z][a-z]+(?:Fi|Swap|Dex|Pay|Lend|Stake|Mint|Chain|Layer|Bridge|Vault|Coin|Token))\b",
    r"\b([A-Z][a-z]{3,})\b",
]
COMMON_WORDS = [
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June", "July", "August",
    "September", "October", "November", "December", "CEO", "CTO", "CFO", "COO",
    "The", "This", "That", "They", "Their", "There", "These", "Those",
    "With", "From", "Into", "About", "After", "Before", "During", "Through",
    "However", "According", "While", "Although", "Because", "Since", "Until",
    "Read", "More", "Also", "Other", "Some", "Most", "Many", "Much", "Such",
    "New", "First", "Last", "Next", "Year", "Years", "Month", "Week", "Day",
]
SUPPORT_TERMS = {
    "Solana": ["solana", "sol"],
    "Starknet": ["starknet", "strk"],
    "USDT": ["usdt", "tether"],
}
SUPPORT_PATTERNS = [
    r"(?:launch|deploy|build|integrate|support|add|enable|live|available|expand)\w*\s+(?:on|to|for|with)",
    r"(?:on|to|for|with)\s+\w*\s*(?:launch|deploy|integration|support)",
    r"(?:native|built|powered)\s+(?:on|by)",
    r"(?:chain|network|blockchain|ecosystem)",
    r"(?:wallet|swap|bridge|dex|defi|nft)",
]
EMPTY_RESEARCH_COMMENT = "No relevant mentions"

# --- Text: fixed values -----------------------------------------------------

TRANSCRIPT_HEADERS = ["WEBVTT", "Kind:", "Language:"]
FILLER_PATTERNS = [
    r"\b[Uu]h+\b", r"\b[Uu]m+\b", r"\b[Hh]mm+\b", r"\b[Ee]r+\b", r"\b[Aa]h+\b",
]
SPOKEN_SUFFIXES = [
    "(BBG)", "(RT)", "(CNBC)", "(FT)", "(WSJ)", "(NYT)", "(NBC)", "(TC)",
    "(ExecSum)", "(Bloomberg)", "(Reuters)", "(Financial Times)",
]
SPOKEN_REPLACEMENTS = [
    (" bps", " basis points"),
    (" BPS", " basis points"),
    (" bp ", " basis point "),
    (" bp.", " basis point."),
    (" YoY", " year over year"),
    (" YTD", " year to date"),
    (" ATH", " all-time high"),
    (" QoQ", " quarter over quarter"),
    (" MoM", " month over month"),
    (" 1Y ", " one-year "),
    (" 2Y ", " two-year "),
    (" 3Y ", " three-year "),
    (" 4Y ", " four-year "),
    (" 5Y ", " five-year "),
    (" 7Y ", " seven-year "),
    (" 10Y ", " ten-year "),
    (" 30Y ", " thirty-year "),
    ("Y-", "-year-"),
    ("2Y-10Y", "2-year-10-year"),
]
TITLE_REPLACEMENTS = [
    (" | ", " - "), ("|", " - "), (":", ""), ("!!", "!"), ("??", "?"), ("...", ""),
]
TITLE_EMOJI = "🔥🚀📉📈💥⚡🚨💰🎯✅❌🔴🟢⬆️⬇️"
INTRO_PATTERNS = [
    r"^(hey (guys|everyone|folks))[,!.]?\s*",
    r"^(what'?s up (guys|everyone|folks))[,!.]?\s*",
    r"^(welcome back to)[^.]*[.!]\s*",
    r"^(in this video)[^.]*[.!]\s*",
    r"^(today we'?(re|ll))[^.]*[.!]\s*",
]
SUMMARY_SENTENCES = 25
PROMPT_MARKERS = ["TRANSCRIPT:\n", "Transcript:\n", "Article Content:\n"]
SHORT_TEXT_CHARS = 1500
ROUTE_TOKENS = 10000
WORDS_PER_MINUTE = 150
LONG_MINUTES = 30

# --- Dates: fixed values ----------------------------------------------------

ISSUE_DATE_PATTERN = (
    r"(?i)((?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?"
    r"|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},?\s+\d{4})"
)

# Formats are Java patterns; a weekday prefix ("Mon, ") is removed beforehand.
DATE_FORMATS_FILTER = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "MMMM d, yyyy"]
DATE_FORMATS_ARCHIVE = [
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-M-d", "MMMM d, yyyy", "MMM d, yyyy",
]
DATE_FORMATS_FEED = [
    "yyyy-M-d", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ssXXX", "MMMM d, yyyy", "MMM d, yyyy",
    "d MMMM yyyy", "d MMM yyyy", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z",
]
DATE_FORMATS_NEWSLETTER = [
    "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss",
    "MMM d, yyyy", "MMMM d, yyyy", "yyyy-M-d", "M/d/yyyy", "d MMM yyyy",
]
VIDEO_DATE_PREFIXES = ["Streamed ", "Premiered ", "Scheduled for "]
DATE_CLASS_MARKS = ["date", "published", "post-date", "entry-date", "timestamp"]
NUMERIC_DATE_PATTERN = r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})"
MONTH_DATE_PATTERN = r"(?i)((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4})"

# --- Usage metering: fixed values -------------------------------------------

# (model pattern, dollars per million input tokens, dollars per million output tokens)
PRICING = [
    ("gemini-2.5-flash", 0.15, 0.60),
    ("gemini-2.5-pro", 1.25, 10.00),
    ("gemini-2.0-flash", 0.10, 0.40),
    ("gemini-1.5-flash", 0.075, 0.30),
    ("gemini-1.5-pro", 1.25, 5.00),
]
DEFAULT_PRICE = (0.10, 0.40)
# (model pattern, calls per minute, calls per day)
RATE_LIMITS = [
    ("gemini-2.5-flash", 10, 500),
    ("gemini-2.5-pro", 5, 50),
    ("gemini-2.0-flash", 10, 1000),
    ("gemini-1.5-flash", 10, 1000),
    ("gemini-1.5-pro", 2, 50),
]
DEFAULT_RATE_LIMIT = (5, 100)
CHARS_PER_TOKEN = 4
THINKING_MARK = "2.5"
THINKING_MULTIPLIER = 5
LOG_ROWS = 500
HISTORY_DAYS = 90
DEFAULT_LIMITS = {
    "daily_max_calls": 500,
    "monthly_max_calls": 10000,
    "enabled": True,
    "monthly_budget_usd": 0.0,
    "cooldown_enabled": True,
    "free_tier_only": True,
}

# --- Tables: fixed values ---------------------------------------------------

CANONICAL_COLUMNS = [
    "title", "url", "source_name", "category", "description", "author",
    "date_published", "date_extracted",
    "grid_asset_id", "grid_matched", "grid_profile_id", "grid_confidence",
    "grid_entity_name", "grid_match_count", "grid_product_id", "grid_profile_name",
    "grid_product_name", "grid_entity_id", "grid_asset_name", "grid_subjects",
    "comments", "grid_asset_ticker",
]
CHECKBOX_COLUMNS = ["Processed", "Added"]
PREVIEW_COLUMNS = ["title", "url", "date_published", "source_name", "description"]
EXPORT_COLUMNS = ["title", "url", "category", "source_name", "date_published"]
ITEM_JSON_FIELDS = [
    "title", "url", "source_name", "category", "description", "author",
    "date_published", "date_extracted",
]
SOURCE_TYPE_ORDER = ["youtube", "article_archive", "newsletter", "rss"]
RESULT_TYPE_ORDER = ["youtube", "newsletter", "rss"]
STATE_TTL_DAYS = 30
FINISHED_STATUSES = ["completed", "failed", "timeout"]
