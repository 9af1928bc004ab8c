"""URL variants derived from every page, so that rare URL shapes occur at every scale.

A template is a list of pieces: plain text, or one of the page's fields in braces.
``None`` gives a NULL URL. The same templates feed the Spark queries and the SQL.
"""

import re

# fields: url; rest = after '://'; host = rest up to the first slash; tail = rest from there;
# id = page id; b = page id mod 256
TEMPLATES = [
    "{url}",
    "http://{b}.2.3.4/a/{rest}",
    "http://{b}.2.3.4:80/{rest}",
    "https://user:pw@a-b.paypal.{host}:8443/x//y?url=http://evil{id}.tk/z",
    "{rest}",
    "http://{host}:ab/",
    "http://[::1{rest}",
    "http://{host}/%41%2f%20%7E?q=%3D%25{id}&empty=",
    "http://{host}/x/a{id};b=1?c=1",
    "http://uni{id}.school.education/{id}",
    "https://shop{id}.co.uk/login.php?redirect_url=//{host}/next&next=https://t.co",
    "http://{host}/?sid=aab{id}&SID=b%20c&sid=&token=x+y%zz&Sid",
    None,
    "",
    "HTTP://WWW.{host}/ABC/DEf{id}.PDF?Q=A",
    "http://bit.ly/{id}",
    "http://a1b.co/{id}",
    "http://abc.io/redirect//{id}",
    "ftp://files{id}.{host}/../..\\..\\etc/passwd!!!!@@$$",
    "http://0x7f000001.{host}/base64.{id}==&&",
    "http://раураl{id}.{host}/wëb/é²½?x=日本{id}",
    "http://m{id}.weebly.com:99999/",
    "http://bank4567{id}.xyz:8081/hex-{id}//a?goto=http://x.com&forward=1",
    "http://www.ck/{id}",
    "http://a.b{id}.com.ck/",
    "  http://{host}/spaced url\t{id}",
    "http://google.com/{id}",
    "https://xn--80ak{id}.com/aaaaabbbbb/11a1a1",
    "http://{host}/😀😀{id}/a😀b",
    "{b}",
    "mailto:user{id}@{host};x?y",
    "http://{host}:0/{tail}",
    "http://[::1]:8080/{id}",
    "https://blog{id}.wordpress.com:/wp-admin/?return=/home&target=https://a.org//b&target=x",
    "http://x{id}.city.kawasaki.jp/?next=//evil.co.uk&NEXT=1",
    "//cdn{id}.{host}/lib.js#frag?no",
    "http://[abc{id}]/x",
    "http://[{b}.2.3.4]/{id}",
    "http://u@[fe80::{b}:2%eth0]:81/{id}",
]

# variants counted as phishing besides the weak terms
PHISHING_VARIANTS = [1, 2, 3, 10, 11, 19, 20, 22, 27, 33]
WEAK_TERMS = "casino-win|free-bets|cheap-pills|spam-farm|adult-x"


def pieces(template: str) -> list[tuple[str, bool]]:
    """[(text, is_field)] of a template."""
    out = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 or piece:
            out.append((piece, bool(i % 2)))
    return out or [("", False)]
