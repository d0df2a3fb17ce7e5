"""The rule pack: (id, severity, confidence, pattern), written for this engine from public weakness catalogues.

Patterns keep to what java.util.regex and RE2 read alike: no look-around, no back-references.
"""

import re

from pyspark.sql import Column, functions as F

try:  # Python's own reading of a pattern is no public interface; without it texts are searched for every pattern
    from re import _constants, _parser
except ImportError:
    _constants = _parser = None

# Severities c, h, m, l are critical, high, medium, low.
SECURITY = r"""
hardcoded-secret-aws c 0.98 \bA(KIA|SIA)[0-9A-Z]{16}\b
hardcoded-secret-generic c 0.82 (?i)\b(api_?key|secret|token|passw(or)?d)\w*["']?\s*[:=]\s*["'][^"'\s]{12,}["']
hardcoded-pem-key c 0.99 -----BEGIN [A-Z ]*PRIVATE KEY-----
sql-injection c 0.9 (?i)\b(select|insert|update|delete)\b[^;"'`\n]{0,120}["'`]\s*\+\s*\w+
command-injection c 0.88 \b(exec|execSync|spawn|system|popen)\(\s*[`"'][^`"'\n]*(\$\{|["']\s*\+)
eval-usage h 0.9 \b(eval|new Function)\s*\(
dangerous-innerhtml h 0.88 dangerouslySetInnerHTML
innerhtml-assignment h 0.82 \.(inner|outer)HTML\s*=[^=]
ssrf-risk h 0.8 \b(fetch|axios(\.\w+)?|got|request)\(\s*(req|request|ctx)\.(query|body|params)
weak-crypto-md5 h 0.95 (?i)\bcreateHash\(\s*["']md5["']|\bmd5\(
weak-crypto-sha1 m 0.92 (?i)\bcreateHash\(\s*["']sha-?1["']|\bsha1\(
insecure-random m 0.55 \bMath\.random\(\)
jwt-no-verify h 0.92 \bjwt\.decode\(
timing-attack m 0.7 (?i)\b(token|signature|hmac|secret|digest)\s*={2,3}\s*\w
insecure-cookie h 0.88 (?i)\b(httpOnly|secure)\s*:\s*false
cors-wildcard h 0.85 (?i)access-control-allow-origin["']?\s*[,:]\s*["']\*
sensitive-url-params h 0.8 (?i)[?&](password|token|secret|api_?key)=
hardcoded-http m 0.72 \bhttp://[a-z0-9.-]+\.[a-z]{2,}
prototype-pollution h 0.92 __proto__|\bconstructor\[["']prototype["']\]
redos-risk h 0.85 \([^()\n]*[+*]\)[+*]
path-traversal h 0.85 \b(readFile|readFileSync|createReadStream|sendFile|open)\([^)\n]*\breq\.(query|params|body)
console-log-secret h 0.65 (?i)console\.\w+\([^)\n]*(password|secret|token|api_?key)
open-redirect h 0.88 \bredirect\(\s*(req|request|ctx)\.(query|body|params)
xxe-injection m 0.6 (?i)<!ENTITY\s|\bnoent\s*:\s*true
unsafe-npm-scripts m 0.9 "(pre|post)install"\s*:\s*"[^"\n]*(curl|wget)\b
nosql-injection h 0.82 (?i)\$where\b|\.find(One)?\(\s*req\.(body|query)
ldap-injection h 0.78 \((uid|cn|sn|mail)=["'`]?\s*(\+|\$\{)
header-injection h 0.8 \bsetHeader\([^)\n]*\breq\.(query|body|params|headers)
jwt-algorithm-none c 0.98 (?i)\balgorithms?["']?\s*:\s*\[?\s*["']none["']
jwt-weak-secret h 0.75 \bjwt\.sign\([^,\n]+,\s*["'][^"'\n]{1,15}["']
template-injection c 0.88 \b(render_template_string|Template|compile)\(\s*(req|request)\.
unsafe-deserialize c 0.88 \b(pickle\.loads?|yaml\.load|unserialize|Marshal\.load)\(
graphql-introspection m 0.8 \bintrospection\s*:\s*true
graphql-depth-limit m 0.6 new ApolloServer\(\s*\{
api-route-no-auth m 0.58 export\s+(default\s+)?async\s+function\s+(GET|POST|PUT|DELETE|handler)\b
idor-risk m 0.65 \bfind(Unique|ById|One)\([^)\n]*\b(params|query)\.id\b
missing-xframe m 0.9 (?i)\bframeguard\s*:\s*false
session-fixation h 0.8 \breq\.session\.\w+\s*=\s*req\.(body|query)
mass-assignment h 0.78 \b(create|update|assign)\(\s*(\{\s*data\s*:\s*)?req\.body\b
exposed-stack-trace h 0.85 \b(json|send)\([^)\n]*\b(err|error|e)\.stack\b
weak-password-policy m 0.72 (?i)\bpassword\.length\s*(<|>=?)\s*[1-7]\b
token-localstorage h 0.88 (?i)\b(local|session)Storage\.setItem\(\s*["'][^"'\n]*(token|jwt|auth)
unvalidated-file-upload h 0.72 \bmulter\(\s*\)|\bupload\.(single|any)\(
server-env-in-client h 0.65 ["']use client["']
debug-mode l 0.6 (?i)\bdebug\s*[:=]\s*true\b
tls-reject-unauthorized c 0.96 rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*["']?0
credentials-in-url c 0.95 \b[a-z]+://[^/\s:@"']+:[^/\s:@"']+@
uuid-v1-predictable m 0.88 \buuid\.?v1\(|\buuid1\(
client-redirect-injection h 0.78 \blocation(\.href)?\s*=\s*[^=;\n]*\b(search|hash|searchParams)\b
toctou-fs m 0.68 \b(existsSync|os\.path\.exists)\(
jwt-no-expiry h 0.78 \bjwt\.sign\([^,()\n]+,[^,()\n]+\)
bcrypt-weak-rounds m 0.85 \b(hash|hashSync|genSalt|genSaltSync)\([^)\n]*\b[1-9]\s*\)
missing-rate-limit m 0.55 (?i)\.post\(\s*["']/(login|signin|register)
express-no-helmet m 0.6 \bexpress\(\)
stripe-webhook-no-verify c 0.75 (?i)stripe[^\n]*webhook[^\n]*JSON\.parse
cors-reflect-origin h 0.82 (?i)allow-origin[^\n]*\breq\.headers\.origin
postmessage-no-origin h 0.75 \bpostMessage\([^)\n]*["']\*["']
hardcoded-service-token c 0.97 \b(ghp_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})
nextjs-server-action-no-auth h 0.7 ["']use server["']
missing-csp m 0.58 (?i)\bcontentSecurityPolicy\s*:\s*false
upload-path-user-controlled c 0.8 \b(writeFile|writeFileSync|createWriteStream)\([^)\n]*\b(req|file)\.\w*name
missing-db-transaction m 0.65 await\s+\w+\.\w+\.(create|update|delete)\([^\n]*\n\s*await\s+\w+\.\w+\.(create|update|delete)\(
graphql-mutation-no-auth h 0.65 \bMutation\s*:\s*\{
k8s-plaintext-secret h 0.78 (?i)\bkind:\s*Secret\b
docker-root-user m 0.58 (?m)^USER\s+root\b
s3-public-acl c 0.92 (?i)\bacl["']?\s*[:=]\s*["']public-read
regex-from-user-input h 0.9 \bnew RegExp\(\s*(req|request|input|query)\b
"""
QUALITY = r"""
todo-fixme l 0.85 \b(TODO|FIXME|HACK|XXX)\b
any-type l 0.85 :\s*any\b|\bas any\b
empty-catch m 0.85 \bcatch\s*(\([^)]*\))?\s*\{\s*\}
use-var l 0.85 (?m)^\s*var\s+\w+
ts-ignore l 0.85 @ts-(ignore|nocheck)
nested-ternary l 0.85 \?[^?:\n]+:[^?:\n]+\?[^?:\n]+:
no-await-in-loop m 0.85 \b(for|while)\s*\([^)\n]*\)\s*\{[^}]*\bawait\b
console-log-debug l 0.85 \bconsole\.(log|debug)\(
async-no-await l 0.85 \basync\s+function\s+\w+\([^)\n]*\)\s*\{\s*return\b
magic-numbers l 0.85 [=<>*+]\s*[0-9]{4,}\b
promise-no-catch m 0.85 \.then\([^)\n]*\)\s*;
callback-hell l 0.85 \}\)\s*;?\s*\n\s*\}\)\s*;?\s*\n\s*\}\)
commented-code l 0.85 (?m)^\s*//\s*(const|let|var|if|for|return|function)\b
no-explicit-return-type l 0.85 \bexport\s+function\s+\w+\([^)\n]*\)\s*\{
long-parameter-list l 0.85 \bfunction\s+\w+\(([^,)\n]*,){5,}
hardcoded-localhost l 0.85 \b(localhost|127\.0\.0\.1)\b
missing-key-prop m 0.85 \.map\([^)\n]*=>\s*\(?\s*<[a-z]+>
useeffect-missing-deps l 0.85 \buseEffect\(\s*\(\)\s*=>\s*\{[^}]*\}\s*\)
inline-function-in-jsx l 0.85 \bon[A-Z]\w+=\{\s*\([^)\n]*\)\s*=>
untyped-catch l 0.85 \bcatch\s*\(\s*\w+\s*\)
floating-promise m 0.85 (?m)^\s*\w+\.(save|send|fetch)\([^)\n]*\);
deep-nesting m 0.85 (?m)^(\t{5,}|\x20{20,})(if|for|while)\b
switch-fallthrough m 0.85 \bcase\s+[^:\n]+:\s*\n\s*case\s
double-negation l 0.85 !![A-Za-z_]
string-concat-loop m 0.85 \bfor\s*\([^)\n]*\)\s*\{[^}]*\+=\s*["'`]
hardcoded-port l 0.85 \blisten\(\s*[0-9]{4,5}\b
missing-input-validation m 0.85 =\s*await\s+req\.json\(\)|=\s*req\.body\s*;
for-in-array l 0.85 \bfor\s*\(\s*(const|let|var)\s+\w+\s+in\s
sort-mutation l 0.85 \bprops\.\w+\.(sort|reverse)\(
loose-equality l 0.85 [^=!<>]==[^=]
unsafe-object-spread m 0.85 \{\s*\.\.\.req\.(body|query)
img-missing-alt m 0.85 <img\s+src=["'][^"'\n]*["']\s*/?>
button-missing-type l 0.85 <button(\s+on[A-Z]\w+=\{[^}\n]*\})?>
icon-button-no-label m 0.85 <button[^>\n]*>\s*<(svg|Icon)
non-null-assertion-chain m 0.85 \w!\.\w+!\.
key-from-array-index m 0.85 \bkey=\{\s*(i|idx|index)\s*\}
tsconfig-no-strict m 0.85 "strict"\s*:\s*false
test-without-assertion m 0.85 \b(it|test)\(\s*["'][^"'\n]*["']\s*,\s*\(\)\s*=>\s*\{\s*\}
switch-no-default l 0.85 \bswitch\s*\([^)\n]*\)\s*\{
prisma-raw-sql h 0.85 \$(query|execute)RawUnsafe\b
async-event-handler-no-catch m 0.85 \bon[A-Z]\w+=\{\s*async\b
no-error-boundary l 0.85 \bcreateRoot\(
unused-react-import l 0.85 \bimport\s+React\s+from\b
state-direct-mutation h 0.85 \bthis\.state\.\w+\s*=[^=]
"""
PERFORMANCE = r"""
n-plus-one-query h 0.85 \b(for|forEach|map)\b[^\n]*\{[^}]*\.(findOne|findUnique|findFirst)\(
select-star m 0.85 (?i)\bselect\s+\*\s+from\b
missing-pagination m 0.85 \bfindMany\(\s*\)
sync-file-io h 0.85 \b(readFileSync|writeFileSync|readdirSync)\(
sync-crypto h 0.85 \b(pbkdf2Sync|scryptSync|randomBytesSync)\(
missing-memo l 0.85 \bexport\s+const\s+[A-Z]\w*\s*=\s*\([^)\n]*\)\s*=>\s*\(
new-object-in-render l 0.85 \bstyle=\{\{
missing-lazy-load m 0.85 \bimport\s+\w+\s+from\s+["'][^"'\n]*(chart|editor|map)
event-listener-leak m 0.85 \baddEventListener\(
setinterval-leak m 0.85 (?m)^\s*setInterval\(
lodash-full-import m 0.85 \bimport\s+_\s+from\s+["']lodash["']
moment-import m 0.85 \bfrom\s+["']moment["']
no-caching-header l 0.85 (?i)cache-control["']?\s*[,:]\s*["']no-store
sequential-awaits m 0.85 =\s*await\s+[^\n;]+;\s*\n\s*(const|let)\s+\w+\s*=\s*await\b
fetch-no-timeout m 0.85 \bfetch\(\s*[^,)\n]+\)
img-no-lazy-load l 0.85 <img\s[^>\n]*src=
large-list-no-virtualization m 0.85 \b(items|rows|data)\.map\(
img-not-next-image m 0.85 <img\s
json-stringify-in-render l 0.85 \{\s*JSON\.stringify\(
input-no-debounce m 0.85 \bonChange=\{[^}\n]*fetch
db-no-connection-pool h 0.85 \bnew\s+(Client|Connection)\(
regex-in-render-or-loop l 0.85 \bwhile\s*\([^)\n]*\bnew RegExp\(
unbounded-cache l 0.85 \bconst\s+cache\s*=\s*(\{\}|new Map\(\))
sql-leading-wildcard m 0.85 (?i)\blike\s+["']%
"""
_LEVELS = {"c": "critical", "h": "high", "m": "medium", "l": "low"}


def pack() -> list[tuple[str, str, str, float, str]]:
    """(family, rule, severity, confidence, pattern)."""
    out = []
    for family, block in (("security", SECURITY), ("quality", QUALITY), ("performance", PERFORMANCE)):
        for line in block.strip().splitlines():
            rule, level, confidence, pattern = line.split(" ", 3)
            out.append((family, rule, _LEVELS[level], float(confidence), pattern))
    return out


#: The end of a run of ``\w``, for either side. The JVM's own ``\b`` takes letters beyond ASCII for parts of a word, though
#: its ``\w`` does not; patterns are read as RE2 reads them, where both are ASCII.
_EDGE = {"b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"}


def as_re2(pattern: str | Column) -> str | Column:
    """A pattern whose word boundaries are ASCII ones. An escaped backslash before a b, and quoted patterns, stay."""
    for letter, edge in _EDGE.items():
        old = r"(?<!\\)((?:\\\\)*)\\" + letter
        if isinstance(pattern, str):
            pattern = pattern if r"\Q" in pattern else re.sub(old, lambda m, edge=edge: m[1] + edge, pattern)
        else:
            new = F.regexp_replace(pattern, old, "$1" + edge.replace("\\", "\\\\"))
            pattern = F.when(F.contains(pattern, F.lit(r"\Q")), pattern).otherwise(new)
    return pattern


def needed(pattern: str) -> tuple[bool, list[list[str]]]:
    """What every text that matches a pattern contains: (whether lower-cased, all of these lists, of each one word).

    Read off Python's parse of the pattern, so it follows the pattern when that changes; nothing where there is no parse.
    """
    if _parser is None:
        return False, []
    tree = _parser.parse(pattern)
    low = bool(tree.state.flags & re.IGNORECASE)
    lists = sorted(_lists(tree), key=lambda words: (-min(map(len, words)), len(words)))
    lists = [[w.lower() if low else w for w in words] for words in lists if len(words) <= 12]
    return low, lists[:4]


def _lists(tree) -> list[list[str]]:
    found, run = [], ""
    for kind, value in [*tree, (None, None)]:
        if kind is _constants.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append([run])
            run = ""
        if kind is _constants.SUBPATTERN:
            found += _lists(value[3])
        elif kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0] > 0:
            found += _lists(value[2])
        elif kind is _constants.IN and all(k is _constants.LITERAL for k, _ in value):
            found.append([chr(c) for _, c in value])
        elif kind is _constants.BRANCH:
            branches = [_lists(branch) for branch in value[1]]
            if all(branches):  # of each branch its longest word
                found.append([w for lists in branches for w in max(lists, key=lambda words: min(map(len, words)))])
    return found
