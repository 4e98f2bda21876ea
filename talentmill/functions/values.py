"""Fixed values of the cleaning rules: word lists, lookup tables and patterns whose content and order decide results."""

# Keyword -> seniority; the first hit in this order counts.
SENIORITY = {
    "intern": "intern", "trainee": "intern", "стажер": "intern", "стажёр": "intern",
    "junior": "junior", "jr ": "junior", "jr.": "junior", "entry level": "junior",
    "entry-level": "junior", "начального": "junior", "младший": "junior",
    "без опыта": "junior", "graduate": "junior",
    "middle": "middle", "mid ": "middle", "mid-level": "middle",
    "мидл": "middle", "среднего": "middle", "regular": "middle",
    "senior": "senior", "sr ": "senior", "sr.": "senior", "старший": "senior",
    "lead": "lead", "ведущий": "lead", "главный": "lead", "team lead": "lead",
    "тимлид": "lead", "техлид": "lead",
    "principal": "principal", "staff": "principal",
    "manager": "manager", "руководитель": "manager", "head of": "manager",
    "director": "director", "директор": "director", "vp ": "director",
}

# Role family -> keywords of its titles, in order.
ROLE_FAMILIES = {
    "data_scientist": ["data scientist", "дата сайентист", "ученый по данным"],
    "ml_engineer": ["machine learning", "ml engineer", "deep learning", "ai engineer"],
    "data_engineer": ["data engineer", "etl", "дата инженер", "инженер данных", "big data"],
    "data_analyst": ["data analyst", "аналитик данных", "bi analyst", "bi developer", "бизнес-аналитик"],
    "backend_developer": ["backend", "бэкенд", "python developer", "java developer", "go developer", "разработчик python", "node developer", "php developer", "c# developer"],
    "frontend_developer": ["frontend", "фронтенд", "react developer", "vue developer", "angular"],
    "fullstack_developer": ["full stack", "fullstack", "фулстек"],
    "mobile_developer": ["mobile", "ios developer", "android developer", "flutter", "react native"],
    "devops_engineer": ["devops", "sre", "site reliability", "platform engineer", "infrastructure"],
    "mlops_engineer": ["mlops", "ml platform", "ml infrastructure"],
    "qa_engineer": ["qa", "test", "quality assurance", "тестировщик", "sdet"],
    "security_engineer": ["security", "cybersecurity", "infosec", "безопасност", "пентест"],
    "data_architect": ["data architect", "архитектор данных", "solutions architect"],
    "engineering_manager": ["engineering manager", "tech lead", "team lead", "тимлид", "техлид", "head of", "руководитель", "director of engineering", "vp engineering", "cto"],
    "product_manager": ["product manager", "продакт", "проджект", "scrum master", "product owner"],
    "designer": ["ux designer", "ui designer", "дизайнер", "product designer"],
    "systems_engineer": ["systems engineer", "системный администратор", "network engineer", "сетевой"],
    "nlp_engineer": ["nlp", "natural language", "llm engineer", "conversational ai", "genai"],
    "cv_engineer": ["computer vision", "image processing", "perception engineer"],
    "researcher": ["research scientist", "research engineer", "applied scientist"],
}

# Department -> keywords, in order.
DEPARTMENTS = {
    "Data & Analytics": ["data", "analytics", "business intelligence", "bi", "reporting", "insights"],
    "Machine Learning / AI": ["machine learning", "artificial intelligence", "ai", "ml", "nlp", "llm"],
    "Engineering": ["engineering", "software", "platform", "infrastructure", "backend", "frontend", "fullstack", "mobile", "qa", "security", "devops", "sre"],
    "Product": ["product", "product management", "product manager"],
    "Design": ["design", "ux", "ui", "product design"],
    "Finance": ["finance", "accounting", "fp&a", "financial"],
    "Operations": ["operations", "business operations", "strategy & operations"],
    "Sales": ["sales", "account executive", "business development"],
    "Marketing": ["marketing", "growth", "seo", "content", "brand"],
    "Customer Success / Support": ["customer success", "support", "customer service"],
    "HR / Recruiting": ["people", "talent", "recruiting", "human resources", "hr"],
    "Legal / Compliance": ["legal", "compliance", "privacy", "regulatory"],
}

# Employment type -> keywords, in order.
EMPLOYMENT = {
    "full_time": ["full_time", "full-time", "full time", "fulltime", "employee: full time", "permanent", "perm", "полная занятость", "полный день"],
    "part_time": ["part_time", "part-time", "part time", "частичная занятость", "неполный"],
    "contract": ["contract", "contractor", "fixed-term", "temporary contract", "b2b", "контракт"],
    "freelance": ["freelance", "freelancer", "self-employed", "фриланс"],
    "internship": ["internship", "intern", "стажировка", "стажер", "стажёр"],
    "temporary": ["temporary", "temp", "seasonal", "временная"],
}

# Words that decide the work format.
HYBRID = ["hybrid", "гибрид", "2-3 days in office", "2 days in office", "3 days in office", "split between home and office"]
OFFICE = ["onsite", "on-site", "in-office", "in office", "office-based", "must be on site", "работа в офисе", "в офисе"]
REMOTE = ["remote", "distributed team", "work from home", "wfh", "удалённ", "удален", "дистанц"]

# Visa and relocation wording.
VISA_YES = ["visa sponsor", "sponsorship available", "work permit support", "visa support", "immigration support", "визовая поддержка", "спонсорство визы"]
VISA_NO = ["no visa", "no sponsorship", "without sponsorship", "unable to sponsor", "not eligible for sponsorship"]
RELOCATION = ["relocation", "relocate", "релокац", "переезд"]

# Titles that are no single vacancy.
SUSPICIOUS = [r"\b20\d{2}\b", r"\bsummit\b", r"\bcampaign\b", r"\baccepting applications\b", r"\bprogram\b", r"\bprogramme\b", r"\bcohort\b", r"\bco-op\b", r"\bhackathon\b", r"\bbootcamp\b", r"\bwomen in tech\b", r"\bnext in tech\b", r"\bmonopoly go\b", r"^\s*\d+\s*x\b", r"\b\d+\s+(openings|positions|roles)\b"]

# Valid sources.
SOURCES = ["hh.ru", "greenhouse.com", "lever.co", "ashbyhq.com", "adzuna.com", "usajobs.gov", "arbeitnow.com", "himalayas.app", "unknown"]

# Currency symbols, words and codes.
CURRENCY_SYMBOLS = {
    "c$": "CAD", "a$": "AUD", "s$": "SGD", "hk$": "HKD", "us$": "USD", "£": "GBP", "€": "EUR", "$": "USD",
    "₽": "RUB", "₹": "INR", "zł": "PLN", "₴": "UAH", "₸": "KZT", "¥": "JPY", "₩": "KRW", "₪": "ILS", "₺": "TRY",
}
CURRENCY_WORDS = {
    "usd": "USD", "eur": "EUR", "gbp": "GBP", "cad": "CAD", "aud": "AUD", "sgd": "SGD", "hkd": "HKD", "inr": "INR",
    "rub": "RUB", "rur": "RUB", "руб": "RUB", "рублей": "RUB", "pln": "PLN", "uah": "UAH", "kzt": "KZT", "jpy": "JPY",
    "yen": "JPY", "krw": "KRW", "won": "KRW", "cny": "CNY", "rmb": "CNY", "yuan": "CNY", "brl": "BRL", "mxn": "MXN",
    "ils": "ILS", "nis": "ILS", "shekel": "ILS", "shekels": "ILS", "try": "TRY", "aed": "AED", "chf": "CHF", "sek": "SEK",
    "nok": "NOK", "dkk": "DKK", "nzd": "NZD", "czk": "CZK", "ron": "RON", "huf": "HUF", "bgn": "BGN", "zar": "ZAR",
}
CURRENCY_ALIASES = {"RUR": "RUB", "BYR": "BYN", "US$": "USD", "C$": "CAD", "A$": "AUD", "S$": "SGD", "HK$": "HKD", "NIS": "ILS"}

# Plausible monthly pay by currency.
MONTHLY_BOUNDS = {
    "USD": (1_000, 30_000), "EUR": (1_000, 28_000), "GBP": (1_000, 25_000), "CAD": (1_200, 35_000), "AUD": (1_200, 35_000),
    "SGD": (1_200, 30_000), "INR": (8_000, 800_000), "RUB": (18_000, 1_000_000), "PLN": (2_500, 50_000), "UAH": (7_000, 200_000),
    "KZT": (70_000, 2_500_000), "JPY": (120_000, 4_000_000), "KRW": (1_500_000, 20_000_000), "CNY": (4_000, 120_000),
    "BRL": (1_500, 80_000), "MXN": (4_000, 150_000), "ILS": (4_000, 120_000), "TRY": (8_000, 250_000), "AED": (3_000, 120_000),
    "CHF": (2_000, 40_000), "SEK": (10_000, 250_000), "NOK": (10_000, 250_000), "DKK": (10_000, 250_000), "NZD": (2_000, 35_000),
    "HKD": (8_000, 300_000), "RSD": (40_000, 600_000), "GEL": (1_000, 25_000), "AMD": (150_000, 4_000_000), "MAD": (3_000, 80_000),
    "THB": (10_000, 400_000), "MYR": (2_000, 60_000), "QAR": (3_000, 120_000), "VND": (5_000_000, 200_000_000),
}
DEFAULT_BOUNDS = (800, 50_000)

# Pay periods in order of preference, and months in each.
PERIODS = {"month": 1.0, "year": 1.0 / 12.0, "week": 4.33, "day": 21.0, "hour": 160.0}
PERIOD_HINTS = {
    "hour": [r"/\s*(hour|hr)\b", r"\bper\s+hour\b", r"\bhourly\b", r"\ban?\s+hour\b", r"\bhr\b", r"\bв\s+час\b"],
    "day": [r"/\s*day\b", r"\bper\s+day\b", r"\bdaily\b", r"\bв\s+день\b"],
    "week": [r"/\s*week\b", r"\bper\s+week\b", r"\bweekly\b", r"\bв\s+неделю\b"],
    "month": [r"/\s*(month|mo)\b", r"\bper\s+month\b", r"\bmonthly\b", r"\bв\s+месяц\b"],
    "year": [r"/\s*year\b", r"\bper\s+(year|annum)\b", r"\byearly\b", r"\bannually\b", r"\bannual\b", r"\bp\.?a\.?\b", r"\bв\s+год\b"],
}

# Rates to RUB where no official one is known.
FALLBACK_RUB = {
    "RUB": 1.0, "USD": 82.1314, "EUR": 95.0038, "GBP": 109.8261, "CAD": 59.5112, "AUD": 57.1224, "SGD": 64.0601, "INR": 0.874057,
    "JPY": 0.515156, "KRW": 0.0549154, "CNY": 11.9001, "BRL": 15.7123, "TRY": 1.85341, "AED": 22.3639, "CHF": 103.6882,
    "SEK": 8.83877, "NOK": 8.43619, "DKK": 12.7422, "PLN": 22.2289, "KZT": 0.170281, "BYN": 27.6984, "UAH": 1.87206,
    "UZS": 0.00674321, "NZD": 47.6609, "HKD": 10.5162,
}

# Currency by country where a posting names none.
COUNTRY_CURRENCY = {
    "UNITED STATES": "USD", "CANADA": "CAD", "UNITED KINGDOM": "GBP", "GERMANY": "EUR", "FRANCE": "EUR", "NETHERLANDS": "EUR",
    "IRELAND": "EUR", "ITALY": "EUR", "SPAIN": "EUR", "BELGIUM": "EUR", "AUSTRIA": "EUR", "FINLAND": "EUR", "PORTUGAL": "EUR",
    "GREECE": "EUR", "POLAND": "PLN", "CZECH REPUBLIC": "CZK", "CZECHIA": "CZK", "ROMANIA": "RON", "HUNGARY": "HUF",
    "AUSTRALIA": "AUD", "NEW ZEALAND": "NZD", "INDIA": "INR", "SINGAPORE": "SGD", "JAPAN": "JPY", "SOUTH KOREA": "KRW",
    "CHINA": "CNY", "BRAZIL": "BRL", "MEXICO": "MXN", "ISRAEL": "ILS", "TURKEY": "TRY", "UAE": "AED",
    "UNITED ARAB EMIRATES": "AED", "SWITZERLAND": "CHF", "SWEDEN": "SEK", "NORWAY": "NOK", "DENMARK": "DKK", "RUSSIA": "RUB",
    "KAZAKHSTAN": "KZT", "BELARUS": "BYN", "UKRAINE": "UAH", "UZBEKISTAN": "UZS", "HONG KONG": "HKD", "TAIWAN": "TWD",
    "SOUTH AFRICA": "ZAR", "BULGARIA": "BGN", "SERBIA": "RSD", "CYPRUS": "EUR", "GEORGIA": "GEL", "ARMENIA": "AMD",
    "MOROCCO": "MAD", "THAILAND": "THB", "MALAYSIA": "MYR", "QATAR": "QAR", "VIETNAM": "VND",
}

# Years of experience; the first pattern whose match passes counts.
EXPERIENCE = [
    r"(\d{1,2})\s*[-–—]\s*(\d{1,2})\s+years?\s+of\s+experience",
    r"(?:from|at\s+least|minimum\s+of|min\.?|over)\s*(\d{1,2})\+?\s+years?\s+(?:of\s+)?experience",
    r"(\d{1,2})\+?\s+years?\s+of\s+experience",
    r"(\d{1,2})\+?\s+years?\s+experience",
    r"experience.{0,25}?(\d{1,2})\+?\s+years?",
]
EXPERIENCE_NOT = [
    r"\bcompany\b", r"\borganization\b", r"\bbusiness\b", r"\bheritage\b", r"\bhistory\b", r"\btradition\b", r"\bfounded\b", r"\bsince\s+\d{4}\b",
    r"\bfor\s+(over|more\s+than)\s+\d+\s+years\b", r"\bserving\b", r"\bleading\b", r"\bglobal leader\b", r"\byears of innovation\b",
    r"\b(has|bringing|team\s+with|we\s+have|over|more\s+than)\s+\d+\s+years\s+of\s+experience\b", r"\bexperience\s+delivering\b",
]
EXPERIENCE_YES = [
    r"\brequirements?\b", r"\bqualifications?\b", r"\bwhat you bring\b", r"\byou have\b", r"\bmust have\b", r"\brequired\b", r"\bminimum\b",
    r"\bat least\b", r"\bhands[- ]on\b", r"\bcommercial experience\b", r"\bexperience with\b", r"\bexperience in\b",
]
EXPERIENCE_SECTIONS = [
    r"requirements", r"qualification", r"must have", r"you have", r"what you bring", r"minimum", r"at least", r"experience with", r"experience in",
]

# Words near a salary that speak for or against it.
PAY_WORDS = ["salary", "compensation", "pay range", "base pay", "hourly rate", "pay rate", "ote", "per year", "per month", "per hour", "per annum", "зарплата", "оклад", "оплата", "компенсация", "доход"]
NOT_PAY = [
    r"\bgym\b", r"\bfood\b", r"\bmeal\b", r"\bsnack\b", r"\blunch\b", r"\ballowance\b", r"\bstipend\b", r"\bwellness\b", r"\bequipment\b",
    r"\bhome.?office\b", r"\bco.?working\b", r"\breimburs", r"\bcredit\b", r"\bperks?\b", r"\binsurance\b", r"\bdental\b", r"\bvision\b", r"\bsubsid",
    r"\bgift\b", r"\bacv\b", r"\barr\b", r"\bmrr\b", r"\brevenue\b", r"\bvaluation\b", r"\bfunding\b", r"\braised\b", r"\bcapital\b",
    r"\bseries\s+[a-d]\b", r"\bcustomers?\b", r"\busers?\b", r"\bemployees?\b", r"\bcountries\b", r"\boffices\b", r"\bfounded\b", r"\btransaction",
    r"\bcontract.?value\b", r"\bdeal\s+size\b", r"\bdiscount\b", r"\bfee\b",
]
