"""Fixed values of the URL-threat feature definitions.

The lists below are data: results are only right when they equal these values.
"""

# --- fixed values: split and seed -------------------------------------------------
SEED = 42
TRAIN_SHARE = 0.8
VAL_SHARE = 0.1
TEST_SHARE = 0.1

# --- fixed values: feature names, in output order, by family ----------------------
FEATURE_FAMILIES = {
    "lexical": [
        "URL Length", "Hostname Length", "Domain Length", "TLD Length", "Subdomain Length",
        "Path Length", "Query Length", "Max Token Length", "Min Token Length", "Mean Token Length",
        "Digit Count", "Subdomain Depth", "Domain Hierarchy", "TLD Structure Depth",
        "Encoded Hostname Indicators", "Slash Count", "Dot Count", "Hyphen in Hostname",
        "Query Param Count", "Path Depth", "Port Number", "Has Port", "Traversal Depth",
    ],
    "ratios": [
        "Domain to URL Ratio", "Subdomain to URL Ratio", "Hostname to URL Ratio", "Path to URL Ratio",
        "Query to URL Ratio", "Path to Domain Ratio", "Query to Domain Ratio", "Query to Path Ratio",
        "Uppercase Ratio", "Subdomain Digit Ratio",
    ],
    "entropy": [
        "Hostname Entropy", "Path Entropy", "Query Entropy", "URL 2-Gram Entropy", "URL 3-Gram Entropy",
        "Hostname 2-Gram Entropy", "Domain Entropy", "Path Entropy Variance", "Rolling Entropy Range",
        "Subdomain Entropy Gradient", "Cookie Param Entropy",
    ],
    "composition": [
        "Digits in Hostname", "Alphabetic in Hostname", "Punctuation in URL", "Non-ASCII in URL",
        "Alpha Ratio in Hostname", "Digit Ratio in Hostname", "Special Char Ratio in Hostname",
        "Homoglyph Score",
    ],
    "transitions": [
        "Letter-Digit-Letter Count", "Digit-Letter-Digit Count", "Alpha-Digit Transitions",
        "Digit-Alpha Transitions", "Consecutive Chars", "Consecutive Digits", "Consecutive Letters",
        "Special Char Cluster", "Pattern Density",
    ],
    "heuristics": [
        "Suspicious Keyword", "URL Shortener", "Digits in Subdomain", "Redirect in Path",
        "Long Numeric Domain", "TLD Risk Score", "Suspicious Hosting", "Numeric Domain Pattern",
        "Hex-Encoded IP", "TLD-Domain Mismatch", "Port Mismatch",
    ],
    "protocol": [
        "IP as Hostname", "Non-HTTP Scheme", "WWW Prefix", "TLD is .com", "Punycode Domain",
    ],
    "diversity": [
        "Char Diversity in URL", "Char Diversity in Hostname",
    ],
    "obfuscation": [
        "Obfuscation Chars", "Encoding Keywords", "Redirect Keywords", "Redirect Chain Count",
        "Consecutive Special Chars", "Encoding Bypass Ratio", "Redirect TLD Disparity",
    ],
}

# --- fixed values: terms that make a URL suspicious (lower-cased substring match) --
SUSPICIOUS_TERMS = """
webscr cmd dispatch cgi-bin secure-code webcss
limitation session-expired confirm-paypal updates-paypal
customercare memberinfo webmailcogeco signintowebmail
customercaremember skytool pipind alivesellive
secure-login verify-account confirm-identity update-billing
password-reset account-verify banking-login payment-update
identity-confirm signin-verify password-update secure-signin
wallet-restore verify-now account-suspended unusual-activity
account-limitation security-alert validation-required authorize-login
validate-account authentication-required myaccount-login
000webhostapp yolasite
verification authenticate office365 paypal
weeblysite godaddysites wixsite 000webhost netlify herokuapp
wordpress blogspot sites.google sharepoint s3.amazonaws
drive.google docs.google dropbox mediafire onedrive box
bank credit debit loan investment transfer wire
microsoft apple google facebook instagram amazon netflix
twitter linkedin adobe zoom outlook office icloud
wp-includes wp-admin wp-content plugins tinymce jscripts
mce editors tiny_mce xmlrpc cpanel phpmyadmin admin
service update-payment index.php login.php signin
validate authorize authentication auth session websrc
myaccount confirm verification.php verification.html update.html
.php .html .htm .asp .aspx .jsp .action .do
pdf doc docx xls xlsx csv attachment invoice
""".split()

# --- fixed values: top-level domains scored as rare --------------------------------
RARE_TLDS = """
.xyz .top .club .info .biz .cf .ml .gq .tk
.site .online .buzz .live .icu
.io .app .me .co .ga .cc .cfd .design .shop
.store .tech .link .space .fun .today
.click .work .website .world .digital .network
""".split()

# --- fixed values: hosting services often abused (substring of host) ----------------
SUSPICIOUS_HOSTS = """
weebly.com webflow.io godaddysites.com wixsite.com
netlify.app herokuapp.com 000webhost.com wordpress.com
blogspot.com sites.google.com firebaseapp.com github.io
crazydomains.com squarespace.com myshopify.com glitch.me
repl.co surge.sh now.sh vercel.app pages.dev
""".split()

# --- fixed values: well-known legitimate sites (exact domain.tld) --------------------
MAJOR_SITES = """
google.com microsoft.com apple.com amazon.com youtube.com
facebook.com twitter.com instagram.com linkedin.com github.com
yahoo.com netflix.com wikipedia.org baidu.com live.com
bing.com ebay.com pinterest.com reddit.com dropbox.com
whatsapp.com bitly.com bit.ly tinyurl.com t.co
""".split()

# --- fixed values: trust keywords (substring of domain.tld) --------------------------
TRUST_KEYWORDS = """
.edu .gov .mil .ac.uk .edu.au .gc.ca .gob.mx .gov.uk
university school college institute academy campus
""".split()

# --- fixed values: shortener hosts and the labels exempt from the short-host rule ----
SHORTENER_HOSTS = "bit.ly goo.gl tinyurl.com t.co is.gd buff.ly adf.ly bc.vc".split()
SHORT_HOST_EXEMPT = "com org net edu gov".split()

# --- fixed values: query keys ---------------------------------------------------------
SESSION_KEYS = """
sessionid sessid sid token auth uid user_id visitorid clientid cookie jsessionid
""".split()
REDIRECT_KEYS = """
redirect redirect_url redirecturi return return_to returnurl url goto target next continue
dest destination
""".split()
REDIRECT_MARKERS = ["redirect", "url=", "goto=", "forward="]

# --- fixed values: expected domain lengths per TLD, usual ports, plain escapes ----------
DOMAIN_LENGTH_RANGE = {"com": (3, 12), "net": (3, 10), "org": (3, 8), "io": (2, 6)}
USUAL_PORTS = [80, 443, 8080, 8000, 3000]
PLAIN_ESCAPES = ["%20", "%21", "%2F", "%3A", "%3F", "%3D"]
HOMOGLYPHS = "аеіос"  # Cyrillic letters that look like a e i o c
PUNCTUATION = "!@#$%^&*()"

# --- fixed values: URL schemes whose last path segment may carry ;parameters -----------
PARAM_SCHEMES = ["", *"""
ftp hdl prospero http imap https shttp rtsp rtsps rtspu sip sips mms sftp tel
""".split()]

# --- fixed values: characters whose NFKC form holds one of / ? # @ : ---------------------
HOST_BREAKING_CHARS = "⁇⁈⁉℀℁℅℆⩴︓︖﹕﹖﹟﹫＃／：？＠"

# --- default public suffixes; pass a fuller table to override (see operators.suffix) -----
GENERIC_SUFFIXES = """
com net org edu gov mil int info biz name pro io co me tv cc ai app dev page xyz top club site online
buzz live icu shop store tech link space fun today click work website world digital network design cfd
cloud blog email news media academy education university school college institute agency
""".split()
COUNTRY_SUFFIXES = """
ac ar at au be br ca ch cl cn cz de dk es eu fi fr gl gr hk hu id ie il in ir is it jp ke kr ly
ml mx my nl no nz pe ph pk pl pt ro rs ru sa se sg sh sk th tk tr tw ua uk us vc vn za gd ga gq cf
""".split()
SECOND_LEVEL_SUFFIXES = """
co.uk ac.uk gov.uk org.uk me.uk net.uk com.au edu.au gov.au net.au org.au com.br gov.br org.br
gob.mx com.mx gc.ca co.jp ac.jp ne.jp or.jp co.nz co.za co.in co.kr com.cn com.hk com.tr com.sg com.tw
""".split()
WILDCARD_SUFFIXES = ["ck", "kawasaki.jp"]  # every label directly below is a suffix
EXCEPTION_SUFFIXES = ["www.ck", "city.kawasaki.jp"]  # except these names

# --- fixed values: n-gram fit, selection and model settings ------------------------------
NGRAM_SIZES = (2, 3)
NGRAM_MIN_DF = 8
NGRAM_MAX_DF = 0.9
NGRAM_MIN_VARIANCE = 5e-5
NGRAM_TOP = 5000
NGRAM_L1_C = 0.5
NGRAM_VALIDATION_C = 5.0

STABILITY_RUNS = 20
STABILITY_FRACTION = 0.905
STABILITY_C = 0.191
STABILITY_MIN_COEF = 1e-5
FREQUENCY_THRESHOLD = 0.705
MI_WEIGHT = 0.318
FREQUENCY_WEIGHT = 0.767
CORRELATION_THRESHOLD = 0.956
CORRELATION_DEFAULT = 0.950
MAX_FEATURES = 1000
IMPORTANCE_TREES = 200

FOCAL_GAMMA = 1.21
FOCAL_ALPHA = 0.42
BOOST_ROUNDS = 1000
BOOST_LEAVES = 50
BOOST_RATE = 0.15
BOOST_MIN_CHILD = 40
BOOST_L1 = 0.1
BOOST_L2 = 0.3

TOP_IMPORTANCE = 60
IMPORTANCE_BAND = 15
SUMMARY_TOP = 40
WATERFALL_BARS = 30
