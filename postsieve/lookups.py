"""Fixed values that results depend on, as plain tables."""

# Extensions of files that can be run.
EXECUTABLE = (
    "ac acc acr ade adp air apk app appimage applescript appx appxbundle asp atmx ba_ bas bat beam bin btm bundle cab ccs cfs cgi chm class "
    "cmd coffee com command cpl crt csh cyw dat dek diagcab diagcfg diagpack dld dll dmg drv dylib e_e ebm ebs ebs2 eham elf epk esh ex ex_ "
    "exe exe1 exz ezt fba frs fxp grp ham hlp hta htx img inf ink ins ipa ipf ipk iso isp isu jar je jnlp js jse jsf jsx ksh ldb lib lnk mac "
    "mad mam mda mdb mde mdz mem ms msc msh msh1 msh1xml msh2 msh2xml mshxml msi msix msixbundle msp mst msu mxe nexe nsh o ocx ore osx otm "
    "out ovl paf paf.exe pcd php php3 pif plx prg ps1 ps1xml ps2 ps2xml psc1 psc2 pxo pyc pyo qit reg rfu rgs run sbs sca scar scb scf scpt "
    "scr script sct server sh shb shd shortcut shs sk snap snp sys tcp torrent tpk udr upx uvm vb vba vbe vbs vbscript vdl vdo vexe vhd vxd "
    "wasm wat wcm wiz wpk ws wsc wsf wsh wst x86 xap xbap xbe xex xll xlm"
).split()
ARCHIVE = "zip rar 7z tar gz bz2 xz arj cab lzh ace iso".split()
MACRO_SCRIPT = "vbs vba ps1 bat cmd scr pif".split()
MACRO_OFFICE = "docm xlsm pptm xlam dotm xltm potm".split()
LEGACY_OFFICE = "doc xls ppt dot xlt pot xla ppa".split()
# First bytes of the kinds of files whose extension is in EXECUTABLE, in hex.
MAGIC = {"4D5A": "exe", "7F454C46": "elf", "CAFEBABE": "class", "0061736D": "wasm", "4D534346": "cab", "4C00000001140200": "lnk"}
GTUBE = "XJS*C4JDBQADN1.NSBN3*2IDNEN*GTUBE-STANDARD-ANTI-UBE-TEST-EMAIL*C.34X"

# Text patterns of macros, in lower case.
MACRO_TEXT = {
    "vba": [r"sub\s+\w+\s*\(", r"function\s+\w+\s*\(", r"dim\s+\w+\s+as\s+\w+", r"application\.run", r"shell\s*\("],
    "powershell": [r"powershell", r"invoke-expression", r"iex\s*\(", r"start-process", r"new-object\s+system\."],
    "javascript": [r"eval\s*\(", r"document\.write", r"activexobject", r"wscript\.", r"new\s+activexobject"],
    "batch": [r"@echo\s+off", r"cmd\s*/c", r"start\s+/b", r"for\s+/[lrf]"],
}

# Date patterns whose crowding is suspicious, in lower case.
DATES = [
    r"\b(?:\d{1,2}[/-]){2}\d{2,4}\b",
    r"\b\d{4}(?:[/-]\d{1,2}){2}\b",
    r"\b\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{2,4}\b",
    r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{1,2},?\s+\d{2,4}\b",
]

# Phrases and patterns of the heuristic rules, in lower case.
BLOCKED_PHRASES = r"cheecck y0ur acc0untt|recorded you|you've been hacked|account is hacked|personal data has leaked|private information has been stolen"
SUBJECT_FAMILIES = [
    r"\b(?:urgent|immediate|action required|act now|limited time|expires?|deadline)\b",
    r"\b(?:free|winner|won|prize|lottery|million|billion|cash|money|investment|profit)\b",
    r"\b(?:verify|confirm|update|suspend|locked|unusual activity|security alert)\b",
    r"\b(?:viagra|cialis|pharmacy|pills|medication|prescription)\b",
    r"\b(?:bitcoin|crypto|btc|eth|nft|blockchain|wallet)\b",
]
BODY_FAMILIES = [
    r"\b(?:nigerian?|prince|inheritance|beneficiary|next of kin|deceased|unclaimed)\b",
    r"\b(?:congratulations[^\n\r]*won|you have been selected|claim your prize)\b",
    r"\b(?:click here to verify|confirm your identity|update your account|suspended[^\n\r]*account)\b",
    r"\b(?:act now|limited time offer|expires in \d+|only \d+ left)\b",
    r"\b(?:wire transfer|western union|moneygram|bank transfer|routing number)\b",
    r"\b(?:enlarge|enhancement|erectile|dysfunction|weight loss|diet pills)\b",
]
SENDER_PATTERNS = [r"^[a-z]+\d{4,}@", r"^[^\n\r]{30,}@", r"@[^\n\r]*(?:\.ru|\.cn|\.tk|\.ml|\.ga|\.cf|\.gq)\z", r"@(?:\d+\.){3}\d+"]
SUSPICIOUS_TLDS = "tk ml ga cf gq xyz top wang win bid loan click link work date racing download stream trade".split()
KEYWORDS = {
    "free": 1, "winner": 2, "prize": 2, "lottery": 3, "urgent": 1, "act now": 2, "limited time": 1, "click here": 1, "unsubscribe": -1,
    "verify your account": 2, "suspended": 2, "inheritance": 3, "million dollars": 3, "wire transfer": 3, "western union": 3, "nigerian": 3,
    "prince": 2, "beneficiary": 2, "congratulations": 1, "selected": 1, "viagra": 3, "cialis": 3, "pharmacy": 2, "bitcoin": 1, "crypto": 1,
    "investment opportunity": 2, "guaranteed": 1, "risk free": 2, "no obligation": 1, "dear friend": 2, "dear customer": 1, "dear user": 1,
}
SHORTENERS = r"\b(?:bit\.ly|tinyurl|goo\.gl|t\.co|ow\.ly|is\.gd|buff\.ly|adf\.ly|j\.mp)\b"
SPOOFED_NAMES = r"^(?:paypal|amazon|apple|microsoft|google|bank|security)"
SPOOFED_HOSTS = r"@(?:paypal|amazon|apple|microsoft|google)\.com\z"
BULK_MAILERS = r"mass mail|bulk mail|email blast"
SYSADMIN_SUBJECTS = r"please moderate|mdadm monitoring|weekly report|wordfence|wordpress|wpforms|docker|graylog|digest|event notification|package update manager|event alert|system events|monit alert|ping|monitor|cron|yum|sendmail|exim|backup|logwatch|unattended-upgrades"
PAYPAL_TYPES = "PPC001017 RT000238 RT000542 RT002947".split()
# Categories and verdicts of a mail exchanger's report header.
EXCHANGE = {
    "high": "cat:malw cat:hphsh cat:hphish cat:hspm".split(), "impersonation": "cat:bimp cat:dimp cat:gimp cat:uimp".split(),
    "spoof": "cat:phsh cat:spoof".split(), "verdict": "sfv:spm sfv:skb sfv:sks".split(), "spam": "cat:ospm cat:spm".split(),
}

# Brands and homograph tables.
BRANDS = "google facebook amazon apple microsoft twitter instagram linkedin youtube netflix paypal ebay yahoo adobe salesforce oracle ibm cisco intel nvidia tesla citibank bankofamerica wellsfargo chase americanexpress".split()
IDN_WHITELIST = "xn--fsq.xn--0zwm56d xn--fiqs8s xn--fiqz9s xn--j6w193g xn--55qx5d xn--io0a7i".split()
CONFUSABLE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "α": "a", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ι": "i", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "𝐚": "a", "𝐛": "b", "𝐜": "c", "𝐝": "d", "𝐞": "e", "𝟎": "0", "𝟏": "1", "𝟐": "2", "𝟑": "3", "𝟒": "4", "ℯ": "e", "ℊ": "g", "ℎ": "h", "ℓ": "l", "ℴ": "o", "ⅰ": "i", "ⅴ": "v",
}
# Signs that stand for several letters.
CONFUSABLE_LONG = {"ⅱ": "ii", "ⅲ": "iii", "ⅳ": "iv"}
# Words that replacement tables mark, and the replacements used without a table.
REPLACEMENT_WORDS = "url email number currency initialism abbreviation emoji hexa mac phone bitcoin cc".split()
BASIC_REPLACEMENTS = [("2", "to"), ("4", "for"), ("u", "you"), ("ur", "your"), ("r", "are"), ("n", "and"), ("w/", "with"), ("b4", "before")]
# Names of mailbox files.
MBOX_NAMES = r"(?:\.mbox|\.mbox\..*|\.mail|\.mail\..*|\.orig|\.(?:19|20)\d{2}\.\d{2})\z|^(?:19|20)\d{2}-\d{2}\z"
CONTEXT_PATTERNS = [r"urgent", r"verify[^\n\r]*account", r"suspended", r"click[^\n\r]*here", r"limited[^\n\r]*time", r"act[^\n\r]*now", r"confirm[^\n\r]*identity"]

# Two-label suffixes, of the rules and of the attributes; they are not the same list.
RULE_SUFFIXES = "co.uk com.au co.nz co.jp com.br co.in".split()
ATTRIBUTE_SUFFIXES = "co.uk com.au co.nz co.jp com.br co.in org.uk net.au com.mx com.cn com.tw com.hk co.za com.sg".split()

# Suffixes that firms let out, a default that callers replace.
PRIVATE_SUFFIXES = "github.io blogspot.com herokuapp.com netlify.app vercel.app pages.dev web.app firebaseapp.com".split()

# Three-letter language codes.
LANGUAGE_CODES = {"eng": "en", "fra": "fr", "deu": "de", "spa": "es", "ita": "it", "por": "pt", "rus": "ru", "zho": "zh", "cmn": "zh", "jpn": "ja", "kor": "ko", "nld": "nl", "pol": "pl", "swe": "sv", "dan": "da", "nor": "no", "fin": "fi", "tur": "tr", "ara": "ar", "heb": "he", "ell": "el", "hun": "hu", "ces": "cs", "ukr": "uk"}
AUTH_WEIGHTS = {"dkim": (-2, 3), "spf": (-1, 2), "dmarc": (-2, 4), "arc": (-1, 1)}
FEEDBACK_TYPES = "abuse fraud virus other not-spam auth-failure dmarc".split()
# Names of Spark's stop lists by language.
STOP_LISTS = {"en": "english", "da": "danish", "nl": "dutch", "fi": "finnish", "fr": "french", "de": "german", "hu": "hungarian", "it": "italian", "no": "norwegian", "pt": "portuguese", "ru": "russian", "es": "spanish", "sv": "swedish", "tr": "turkish"}
# A short English stop list.
STOP_WORDS = "a an and are as at be but by for from has have he her his i if in is it its me my not of on or our she so that the their them they this to was we were will with you your".split()
