"""Vocabularies of the screening rules, as plain data.

Everything here is a fixed value: results depend on just these words.
"""

# --- fixed values: generic words and affixes ---
GENERIC_WORDS = [
    "the", "a", "an", "daily", "dailies", "weekly", "weeklies", "biweekly", "fortnightly", "monthly", "monthlies", "bimonthly", "quarterly",
    "quarterlies", "half-yearly", "yearly", "annual", "annals", "half", "bi", "tri", "morning", "evening", "sunday", "monday", "tuesday", "wednesday",
    "thursday", "friday", "saturday", "weekend", "today", "now", "current", "hours", "hour", "24x7", "247", "365", "24", "news", "express", "times",
    "chronicle", "chronicles", "herald", "bulletin", "bulletins", "journal", "journals", "gazette", "gazettes", "post", "posts", "mail", "voice",
    "tribune", "mirror", "report", "reports", "reporter", "reporters", "press", "media", "digest", "digests", "review", "reviews", "dispatch",
    "dispatches", "update", "updates", "leader", "courier", "star", "standard", "observer", "frontline", "headlines", "headline", "edition",
    "editions", "network", "channel", "broadcast", "broadcasting", "digital", "online", "info", "information", "new", "super", "mega", "ultra",
    "prime", "real", "true", "live", "direct", "india", "bharat", "hindustan", "national", "regional", "state", "city", "world", "global",
    "international", "universal", "dainik", "saptahik", "pakshik", "masik", "traimasik", "ardhavarshik", "varshik", "varshiki", "samachar",
    "samacharon", "khabar", "khabrein", "khabren", "sandesh", "patrika", "patrikayen", "prabhat", "sandhya", "pratidin", "aaj", "kal", "dopahar",
    "raat", "varta", "vartha", "suchna", "darshika", "shree", "shri", "sri", "naya", "nav", "samvad", "manch", "charcha", "rashtriya", "desh",
    "pradesh", "nagar", "shahar", "gram", "gaon", "apna", "mera", "hamara", "bartaman", "sambad", "khabor", "patra", "murasu", "malai", "sudarmalar",
    "mani", "taaza", "roznama", "haftroza", "mahnama", "akhbar", "akhbarat", "seithi", "seithigal", "dinakaran", "dinamalar", "dinamani", "sakal",
    "praja", "awam", "qaum", "qaumi",
]
PREFIXES = [
    "the", "a", "an", "daily", "weekly", "fortnightly", "monthly", "dainik", "saptahik", "masik", "shree", "shri", "sri", "nav", "naya", "aaj", "new",
    "super", "mega", "ultra", "prime", "real", "true", "live", "direct", "national", "regional", "state", "city", "rashtriya", "global",
    "international", "apna", "mera", "hamara",
]
SUFFIXES = [
    "times", "news", "express", "herald", "chronicle", "chronicles", "bulletin", "bulletins", "journal", "journals", "gazette", "gazettes", "post",
    "posts", "mail", "voice", "samachar", "sandesh", "patrika", "patrikayen", "prabhat", "sandhya", "vani", "varta", "vartha", "today", "now", "live",
    "24x7", "247", "media", "press", "digest", "digests", "review", "reviews", "daily", "weekly", "monthly", "yearly", "annual", "tribune", "mirror",
    "star", "standard", "observer", "report", "reports", "reporter", "courier", "leader", "dispatch", "update", "updates", "headlines", "edition",
    "editions", "network", "channel", "broadcast", "akhbar", "akhbarat", "roznama", "india", "bharat", "hindustan", "national", "regional", "state",
    "city", "world", "global", "international", "universal",
]
PROHIBITED_CHARACTERS = '+=*@#$%^&_~|\\/!?()[]{}<>;:"`©®™°•§¶†‡₹€£¥±÷×√∞'

# --- fixed values: gibberish rules ---
VOWELS = "aeiouy"
CONSONANTS = "bcdfghjklmnpqrstvwxz"
ACRONYMS = [
    "bbc", "cnn", "ndtv", "isro", "pti", "uni", "air", "ani", "aaj", "dd", "etv", "ht", "toi", "ibn", "abp", "tv9", "zeetv", "republic", "news18",
]
INVALID_BIGRAMS = [
    "bk", "bx", "bz", "cb", "cd", "cf", "cg", "cj", "cx", "db", "dc", "df", "dg", "fb", "fc", "fd", "fg", "fj", "fk", "fm", "fn", "fp", "fq", "fx",
    "fz", "gb", "gc", "gd", "gf", "gj", "gk", "gp", "gq", "gx", "gz", "hb", "hc", "hd", "hf", "hg", "hj", "hk", "hp", "hq", "hx", "hz", "jb", "jc",
    "jd", "jf", "jg", "jh", "jk", "jl", "jm", "jn", "jp", "jq", "jr", "js", "jt", "jv", "jw", "jx", "jz", "kx", "kz", "pb", "pc", "pd", "pf", "pj",
    "pq", "px", "pz", "qb", "qc", "qd", "qe", "qf", "qg", "qh", "qi", "qj", "qk", "ql", "qm", "qn", "qo", "qp", "qq", "qr", "qs", "qt", "qv", "qw",
    "qx", "qy", "qz", "sz", "tb", "td", "tf", "tg", "tj", "tq", "vb", "vc", "vd", "vf", "vg", "vh", "vj", "vk", "vm", "vp", "vq", "vx", "vz", "wb",
    "wc", "wd", "wf", "wg", "wj", "wk", "wq", "wx", "wz", "xb", "xc", "xd", "xf", "xg", "xh", "xj", "xk", "xl", "xm", "xn", "xp", "xq", "xr", "xs",
    "xt", "xv", "xw", "xx", "xz", "yq", "yx", "yy", "zb", "zc", "zd", "zf", "zg", "zj", "zk", "zl", "zm", "zn", "zp", "zq", "zr", "zs", "zt", "zv",
    "zw", "zx",
]
INVALID_ENDINGS = [
    "isg", "sg", "brsg", "rtp", "pzx", "xjgh", "zxt", "vbg", "qwr", "bgr", "tpx",
]

# --- fixed values: blacklists; terms by the guideline that bars them ---
ENFORCEMENT_TERMS = [
    ("police", "12"), ("crime", "12"), ("corruption", "12"), ("cbi", "12"), ("cid", "12"), ("army", "12"),
    ("navy", "12"), ("airforce", "12"), ("vigilance", "12"), ("sarkar", "12"), ("sarkari", "12"), ("government", "12"),
    ("govt", "12"), ("lokpal", "12"), ("lokayukta", "12"), ("court", "12"), ("nyayalaya", "12"), ("judge", "12"),
    ("bureau", "7"), ("investigation", "12"), ("intelligence", "12"), ("raw", "12"), ("ed", "12"), ("nia", "12"),
    ("defense", "12"), ("defence", "12"), ("military", "12"), ("crpf", "12"), ("bsf", "12"), ("cisf", "12"),
    ("itbp", "12"), ("nsg", "12"), ("customs", "12"), ("excise", "12"), ("rashtrapati", "4"), ("president", "4"),
    ("pm", "4"), ("cm", "4"), ("prime minister", "4"), ("chief minister", "4"), ("parliament", "7"), ("sansad", "7"),
    ("vidhan sabha", "7"), ("rajya sabha", "7"), ("lok sabha", "7"),
]
EMBLEM_TERMS = [
    ("ashoka chakra", "4"), ("ashok chakra", "4"), ("national emblem", "4"), ("bharat ratna", "4"), ("padma vibhushan", "4"), ("padma bhushan", "4"),
    ("padma shri", "4"), ("united nations", "4"), ("un", "4"), ("unesco", "4"), ("who", "4"), ("interpol", "4"),
    ("gandhi", "4"), ("mahatma gandhi", "4"),
]
OBSCENE_TOKENS = [
    "terrorist", "terrorism", "jihad", "naxal", "naxalite", "extremist", "scam", "fraud", "blackmail", "smuggler", "mafia", "gangster", "don",
    "murder", "killer", "loot", "dacoit", "goonda", "gunda", "fuck", "fucking", "fucked", "fucker", "shit", "bitch", "bastard", "asshole", "ass",
    "crap", "dick", "pussy", "cock", "whore", "slut", "porn", "porno", "pornography", "nude", "erotic", "chutiya", "chutiye", "gandu", "bhosdike",
    "bhosdi", "madarchod", "behenchod", "bhenchod", "gaand", "harami", "kamina", "kamine", "saala", "saali", "kutta", "kutti",
]

# --- fixed values: protected names by category, as (normal form, display) ---
PROTECTED_NAMES = {
    "Brand": [("tata", "Tata"), ("microsoft", "Microsoft"), ("google", "Google"), ("apple", "Apple"), ("amazon", "Amazon"), ("reliance", "Reliance"), ("infosys", "Infosys"), ("wipro", "Wipro"), ("titan", "Titan")],
    "Organization": [("red cross", "Red Cross"), ("unesco", "UNESCO"), ("unicef", "UNICEF"), ("world health organization", "World Health Organization")],
    "Copyright": [("disney", "Disney"), ("marvel", "Marvel"), ("pokemon", "Pokemon")],
}

# --- fixed values: rewrites of romanised Indic words, in order, and sound classes ---
INDIC_REWRITES = [
    (r"sh[h]?", "s"), (r"ch[h]?", "c"), (r"kh", "k"), (r"gh", "g"), (r"th", "t"), (r"dh", "d"), (r"bh", "b"), (r"ph", "f"), (r"aa+", "a"), (r"ee+", "i"), (r"ii+", "i"), (r"oo+", "u"), (r"uu+", "u"), (r"ay", "e"), (r"ai", "e"), (r"au", "o"), (r"ou", "o"), (r"v", "w"), (r"q", "k"), (r"c(?=[eiy])", "s"), (r"c", "k"), (r"z", "j"), (r"x", "ks"),
]
SOUND_CLASSES = ["bfpvw", "cgjkqsxz", "dt", "l", "mn", "r"]

# --- fixed values: affixes and substitutions of the suggestions ---
LANGUAGE_AFFIXES = {
    "Hindi": (["Rashtriya", "Lok", "Jan", "Pratidin", "Swadesh", "Prabhat", "Dainik", "Sanmarg"], ["Sandesh", "Varta", "Samachar", "Jagran", "Uday", "Patrika", "Vani"]),
    "Marathi": (["Maharashtra", "Lok", "Jan", "Prabhat", "Dainik", "Maha"], ["Varta", "Sandesh", "Patrika", "Vrutta", "Vani", "Uday"]),
    "Bengali": (["Ananda", "Pratidin", "Sangbad", "Khabar", "Bangla", "Dainik"], ["Khabar", "Patrika", "Barta", "Darpan", "Samachar"]),
    "Tamil": (["Tamil", "Dina", "Kadir", "Prabha"], ["Vani", "Malar", "Velicham", "Sudhar", "Kadir"]),
    "Telugu": (["Telugu", "Dina", "Praja", "Jan"], ["Vani", "Prabha", "Galam", "Jyothi", "Samachar"]),
    "English": (["Vanguard", "Apex", "Zenith", "Pinnacle", "Astro", "Quantum", "Omni", "Meridian", "Stellar"], ["Chronicle", "Herald", "Observer", "Journal", "Post", "Voice", "Globe", "Courier", "Standard", "Spectrum", "Horizon"]),
}
SUBSTITUTIONS = {
    "namascar": ["Abhinandan", "Swagatam", "Pranama", "Subhashish", "Bandhan"],
    "namaskar": ["Abhinandan", "Swagatam", "Pranama", "Subhashish"],
    "crime": ["Public Truth", "Satyashodhak", "Vigilant Citizen", "Nyaya Mirror"],
    "police": ["Citizen Voice", "Jan Nayak", "Public Watchdog"],
    "investigation": ["Fact Finder", "Satyashodhak", "Transparency Journal"],
    "hindu": ["Hindustan", "Bharat", "Rashtra"],
}

# --- fixed values: the seed registry as (title, language, state); all are dailies ---
SEED_TITLES = [
    ("The Times of India", "English", "Maharashtra"),
    ("The Hindu", "English", "Tamil Nadu"),
    ("The Indian Express", "English", "Delhi"),
    ("Hindustan Times", "English", "Delhi"),
    ("The Telegraph", "English", "West Bengal"),
    ("Deccan Chronicle", "English", "Telangana"),
    ("The Economic Times", "English", "Maharashtra"),
    ("Dainik Jagran", "Hindi", "Uttar Pradesh"),
    ("Dainik Bhaskar", "Hindi", "Madhya Pradesh"),
    ("Amar Ujala", "Hindi", "Uttar Pradesh"),
    ("Punjab Kesari", "Hindi", "Punjab"),
    ("Rajasthan Patrika", "Hindi", "Rajasthan"),
    ("Namaskar India", "Hindi", "Delhi"),
    ("Pratidin Sandhya", "Hindi", "West Bengal"),
    ("Jan Vani", "Hindi", "Uttar Pradesh"),
    ("Dainik Prabhat", "Hindi", "Uttar Pradesh"),
    ("Anandabazar Patrika", "Bengali", "West Bengal"),
    ("Bartaman", "Bengali", "West Bengal"),
    ("Lokmat", "Marathi", "Maharashtra"),
    ("Daily Sakal", "Marathi", "Maharashtra"),
    ("Dina Thanthi", "Tamil", "Tamil Nadu"),
    ("Dinamalar", "Tamil", "Tamil Nadu"),
    ("Eenadu", "Telugu", "Andhra Pradesh"),
    ("Sakshi", "Telugu", "Andhra Pradesh"),
    ("Malayala Manorama", "Malayalam", "Kerala"),
    ("Mathrubhumi", "Malayalam", "Kerala"),
    ("Gujarat Samachar", "Gujarati", "Gujarat"),
    ("Sandesh", "Gujarati", "Gujarat"),
    ("Ajit", "Punjabi", "Punjab"),
    ("Inquilab", "Urdu", "Maharashtra"),
    ("The Siasat Daily", "Urdu", "Telangana"),
]
