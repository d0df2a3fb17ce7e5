"""Public advisories: package, registry, the first version without the flaw, the advisory's public number.

An own selection from the CVE list, across registries, of packages that are in wide use.
"""

from __future__ import annotations

ADVISORIES = [
    ("actionpack", "rubygems", "7.0.8.1", "CVE-2024-26143"),
    ("aiohttp", "pypi", "3.9.2", "CVE-2024-23334"),
    ("axios", "npm", "1.6.0", "CVE-2023-45857"),
    ("body-parser", "npm", "1.20.3", "CVE-2024-45590"),
    ("braces", "npm", "3.0.3", "CVE-2024-4068"),
    ("certifi", "pypi", "2023.7.22", "CVE-2023-37920"),
    ("com.fasterxml.jackson.core:jackson-databind", "maven", "2.13.4.2", "CVE-2022-42003"),
    ("cross-spawn", "npm", "7.0.5", "CVE-2024-21538"),
    ("cryptography", "pypi", "42.0.4", "CVE-2024-26130"),
    ("express", "npm", "4.19.2", "CVE-2024-29041"),
    ("flask", "pypi", "2.2.5", "CVE-2023-30861"),
    ("follow-redirects", "npm", "1.15.6", "CVE-2024-28849"),
    ("github.com/gin-gonic/gin", "go", "1.9.1", "CVE-2023-29401"),
    ("golang.org/x/crypto", "go", "0.31.0", "CVE-2024-45337"),
    ("golang.org/x/net", "go", "0.17.0", "CVE-2023-39325"),
    ("gunicorn", "pypi", "22.0.0", "CVE-2024-1135"),
    ("idna", "pypi", "3.7", "CVE-2024-3651"),
    ("ip", "npm", "2.0.1", "CVE-2023-42282"),
    ("jinja2", "pypi", "3.1.3", "CVE-2024-22195"),
    ("json5", "npm", "2.2.2", "CVE-2022-46175"),
    ("jsonwebtoken", "npm", "9.0.0", "CVE-2022-23540"),
    ("junit", "maven", "4.13.1", "CVE-2020-15250"),
    ("lodash", "npm", "4.17.21", "CVE-2021-23337"),
    ("minimist", "npm", "1.2.6", "CVE-2021-44906"),
    ("moment", "npm", "2.29.4", "CVE-2022-31129"),
    ("next", "npm", "15.2.3", "CVE-2025-29927"),
    ("numpy", "pypi", "1.22.0", "CVE-2021-34141"),
    ("org.apache.commons:commons-text", "maven", "1.10.0", "CVE-2022-42889"),
    ("org.apache.logging.log4j:log4j-core", "maven", "2.15.0", "CVE-2021-44228"),
    ("org.yaml:snakeyaml", "maven", "2.0", "CVE-2022-1471"),
    ("path-to-regexp", "npm", "0.1.12", "CVE-2024-52798"),
    ("pillow", "pypi", "10.0.1", "CVE-2023-4863"),
    ("puma", "rubygems", "6.4.2", "CVE-2024-21647"),
    ("pyyaml", "pypi", "5.4", "CVE-2020-14343"),
    ("requests", "pypi", "2.31.0", "CVE-2023-32681"),
    ("rexml", "rubygems", "3.2.7", "CVE-2024-35176"),
    ("semver", "npm", "7.5.2", "CVE-2022-25883"),
    ("tar", "npm", "6.2.1", "CVE-2024-28863"),
    ("time", "crates", "0.2.23", "CVE-2020-26235"),
    ("tokio", "crates", "1.23.1", "CVE-2023-22466"),
    ("tough-cookie", "npm", "4.1.3", "CVE-2023-26136"),
    ("tqdm", "pypi", "4.66.3", "CVE-2024-34062"),
    ("undici", "npm", "5.28.4", "CVE-2024-30260"),
    ("urllib3", "pypi", "1.26.17", "CVE-2023-43804"),
    ("werkzeug", "pypi", "3.0.3", "CVE-2024-34069"),
    ("word-wrap", "npm", "1.2.4", "CVE-2023-26115"),
    ("ws", "npm", "8.17.1", "CVE-2024-37890"),
]

#: The registry that a manifest's packages come from.
REGISTRIES = {"package.json": "npm", "requirements.txt": "pypi", "go.mod": "go", "Cargo.toml": "crates", "pom.xml": "maven", "Gemfile": "rubygems"}

#: Packages that repositories use beside those, all of one registry.
TOOLS = (
    "typescript jest vitest cypress eslint prettier knex mongoose @nestjs/core react vue passport stripe ioredis bullmq nodemailer prom-client "
    "express-rate-limit helmet csrf-csrf graphql graphql-yoga @sentry/node @playwright/test @trpc/server"
).split()
#: How a manifest is written: before the first package, a package before, between and after its version, between two, at the end.
FORMS = {
    "package.json": ('{"name": "landed", "dependencies": {', '"', '": "^', '"', ", ", '}, "devDependencies": {}}'),
    "requirements.txt": ("# landed\n", "", "==", "", "\n", "\n"),
    "go.mod": ("module landed\nrequire (\n", "\t", " v", "", "\n", "\n)\n"),
    "Cargo.toml": ("[dependencies]\n", "", ' = "', '"', "\n", "\n"),
    "pom.xml": ("", "<dependency><artifactId>", "</artifactId><version>", "</version></dependency>", "\n", ""),
    "Gemfile": ("source 'landed'\n", "gem '", "', '", "'", "\n", "\n"),
}
_FILE = {registry: file for file, registry in REGISTRIES.items()}
#: (number, manifest, package)
CATALOGUE = [(k, file, lib) for k, (file, lib) in enumerate(sorted({(_FILE[a[1]], a[0]) for a in ADVISORIES} | {("package.json", t) for t in TOOLS}))]
