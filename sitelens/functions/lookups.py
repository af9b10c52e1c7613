"""Lookup values that must equal the analysed tool's for identical results.

FIXED VALUES — kept verbatim, in their original order. Order matters where
noted (first-match rules), so never sort or regroup these lists.
"""

from __future__ import annotations

# FIXED VALUES: candidate subdomain labels tried against every target domain.
SUBDOMAIN_LABELS = """
www mail ftp localhost webmail smtp pop ns1 webdisk ns2 cpanel whm autodiscover
autoconfig m imap test ns blog pop3 dev www2 admin forum news vpn ns3 mail2
new mysql old lists support mobile mx static docs beta shop sql secure demo cp
calendar wiki web media email images img www1 intranet portal video sip dns2
api cdn stats dns1 ns4 www3 dns search staging server mx1 chat wap my svn
mail1 sites proxy ads host crm cms backup mx2 lyncdiscover info apps download
remote db forums store relay files newsletter app live owa en start sms office
exchange ipv4 gateway sandbox internal prod assets content data development git
help id lab stage sso status upload v1 v2 ws academy account analytics
""".split()

# FIXED VALUES: technology fingerprints (name, case-insensitive pattern), in order.
TECH_FINGERPRINTS = [
    ("WordPress", r"wp-content|wp-includes|wordpress"),
    ("Drupal", r"drupal|sites/default"),
    ("Joomla", r"joomla|components/com_"),
    ("React", r"react|reactdom"),
    ("Vue.js", r"vue\.js|vue\.min\.js"),
    ("Angular", r"angular|ng-"),
    ("jQuery", r"jquery"),
    ("Bootstrap", r"bootstrap"),
    ("Laravel", r"laravel"),
    ("Django", r"django|csrfmiddlewaretoken"),
    ("Flask", r"flask"),
    ("Node.js", r"X-Powered-By.*Express|X-Powered-By.*Node"),
    ("PHP", r"\.php|X-Powered-By.*PHP"),
    ("ASP.NET", r"aspx|X-AspNet-Version"),
    ("Cloudflare", r"cloudflare|cf-ray"),
    ("Google Analytics", r"google-analytics|gtag"),
    ("AWS", r"amazonaws\.com"),
    ("Apache", r"Server.*Apache"),
    ("Nginx", r"Server.*nginx"),
]

# FIXED VALUES: keyword stop words.
STOP_WORDS = (
    "the be to of and a in that have i it for not on with he as you do at this but his by "
    "from they we say her she or an will my one all would there their what so up out if about "
    "who get which go me when make can like time no just him know take people into year your "
    "good some could them see other than then now look only come its over think also back after "
    "use two how our work first well way even new want because any these give day most us is "
    "are was were been has had did does being am"
).split()

# FIXED VALUES: social platforms (platform, case-insensitive pattern), in order.
SOCIAL_PLATFORMS = [
    ("facebook", r"facebook\.com"),
    ("twitter", r"twitter\.com|x\.com"),
    ("instagram", r"instagram\.com"),
    ("linkedin", r"linkedin\.com"),
    ("youtube", r"youtube\.com"),
    ("tiktok", r"tiktok\.com"),
    ("pinterest", r"pinterest\.com"),
    ("github", r"github\.com"),
    ("reddit", r"reddit\.com"),
]

# FIXED VALUES: downloadable-file extensions; the FIRST one contained in the
# lower-cased href wins, so this order decides the file type.
FILE_EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".rar", ".tar", ".gz", ".csv", ".txt", ".xml", ".json",
]

# FIXED VALUES: challenge-page indicators.
CHALLENGE_MARKERS_OK = [
    "g-recaptcha", "h-captcha", "cf-challenge-form",
    "challenge-platform", "cf-chl-bypass",
]
CHALLENGE_MARKERS_BLOCKED = [
    "recaptcha", "captcha", "g-recaptcha", "hcaptcha", "h-captcha",
    "cf-challenge", "challenge-platform", "checking your browser",
    "please verify you are human", "cloudflare ray id",
]

# Crawler agent per mode (F17). These are parameters, not fixed values: pass
# the agent strings your robots rules name.
USER_AGENTS = {
    "mobile": "SitelensMobile/1.0",
    "pc": "SitelensDesktop/1.0",
}

# FIXED VALUES: phone patterns, applied in this order and concatenated.
PHONE_PATTERNS = [
    r"\+?1?\d{9,15}",
    r"\(\d{3}\)\s*\d{3}-\d{4}",
    r"\d{3}-\d{3}-\d{4}",
    r"\d{3}\.\d{3}\.\d{4}",
]

# FIXED VALUES: e-mail pattern (the literal "|" inside the class is intended).
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"

# FIXED VALUES: inline-script URL and API patterns, and comment URL pattern.
JS_URL_PATTERN = r"""["']([^"']*?\.(?:html|php|asp|aspx|jsp|json|xml|js|css)[^"']*?)["']"""
API_PATTERN = r"""["']/?(?:api|v\d+)/[^"']+["']"""
COMMENT_URL_PATTERN = r"""https?://[^\s<>"]+|www\.[^\s<>"]+"""

# FIXED VALUES: SEO thresholds.
SEO_TITLE_RANGE = (50, 60)
SEO_DESCRIPTION_RANGE = (150, 160)
SEO_MAX_PAGE_BYTES = 3 * 1024 * 1024
SEO_MAX_SECONDS = 3

# FIXED VALUES: keyword extraction defaults.
KEYWORD_MIN_LENGTH = 3
KEYWORDS_PER_PAGE = 100
