"""Labelled lines as they stand in configuration, code, logs and prose, written by hand.

``<kind,n>`` marks a secret of n random characters and ``[kind,n]`` others that
aren't one; what stands directly beside a mark without a space belongs to it.
Only the random parts are drawn, so no real-looking credential is kept here.
"""

from __future__ import annotations

import random
import re
import string

#: The characters of each kind of random part.
KINDS = {"hex": "0123456789abcdef", "alnum": string.ascii_letters + string.digits, "upper": string.ascii_uppercase + string.digits, "digit": string.digits, "base64": string.ascii_letters + string.digits + "+/", "lower": string.ascii_lowercase}

#: Lines to learn from, with their paths.
LINES = [
    ("aws_secret_access_key = <alnum,40>", "home/credentials"),
    ("aws_access_key_id = AKIA<upper,16>", "home/credentials"),
    ("export GITHUB_TOKEN=<hex,40>", "deploy/env.sh"),
    ("git clone https://ghp_<alnum,36>@host/acme/app.git", "ci/build.yml"),
    ("DB_PASSWORD=<alnum,24>", ".env"),
    ('stripe.api_key = "sk_live_<alnum,24>"', "billing/pay.py"),
    ("const apiKey = '<hex,32>';", "web/src/maps.js"),
    ('password: "<alnum,12>!"', "config/database.yml"),
    ('The admin password is set: password = "Tr0ub4dor&<digit,3>" until Friday.', "notes/ops.md"),
    ("Authorization: Bearer <alnum,43>", "logs/request.txt"),
    ("secret: <hex,64>", "k8s/secret.yaml"),
    ('storage_access_key="<base64,43>="', "infra/main.tf"),
    ("passphrase: correct-horse-<digit,3>", "backup/restore.md"),
    ('curl --header "PRIVATE-TOKEN: glpat-<alnum,20>" host', "tools/release.sh"),
    ("smtp_pass: <alnum,16>", "mail/settings.ini"),
    ("token=eyJ<alnum,33>", "session/cookie.txt"),
    ('and then set token = "<hex,40>" in the shell before it runs', "src3"),
    ("le mot de passe, password = <lower,6><digit,4>, est pour tous", "src8"),
    ("commit [hex,40]", "git/log.txt"),
    ("Merge [hex,40] into main", "git/log.txt"),
    ("sha256:[hex,64]  app.tar.gz", "dist/sums"),
    ('"integrity": "sha512-[base64,44]=="', "package-lock.json"),
    ("md5 checksum [hex,32] matches", "logs/copy.log"),
    ("request id [hex,8]-[hex,4]-4[hex,3]-a[hex,3]-[hex,12] took 32 ms", "logs/web.log"),
    ('<img src="/static/img/[alnum,22].png">', "web/index.html"),
    ("see https://host/articles/2019/the-long-title-of-an-article-[digit,2]", "notes/links.md"),
    ('password = os.environ["DB_PASSWORD"]', "app/settings.py"),
    ("password: ${DB_PASSWORD}", "docker-compose.yml"),
    ("token: your_token_here", "README.md"),
    ('api_key = "YOUR_API_KEY"', "docs/start.md"),
    ('password = "changeme"', "docs/start.md"),
    ("the token: required for all calls", "docs/api.md"),
    ("secret = None", "app/config.py"),
    ("order [digit,16] shipped", "mail/orders.txt"),
    ("card [digit,16] declined", "logs/pay.log"),
    ("from package.module_one.submodule_two[digit,1].helper_functions import run", "src/app.py"),
    ("def test_user_can_reset_password_after_[digit,2]_days(self):", "tests/test_user.py"),
    ("MAX_CONNECTION_POOL_SIZE_[digit,2] = limit", "src/db.py"),
    ("layer_[digit,1]_attention_output_dense_weight_[digit,1]", "model/names.txt"),
    ("tracking number 1Z[digit,16]", "mail/orders.txt"),
    ('etag: "[hex,32]"', "logs/http.txt"),
    ("build-2021[digit,4]-nightly-linux-x86_64", "ci/names.txt"),
    ("data:image/png;base64,[base64,60]", "web/style.css"),
    ("trace [hex,32] span [hex,16]", "logs/trace.txt"),
    ("passwordless login is on since v[digit,1]", "CHANGELOG.md"),
]

_MARK = re.compile(r"(\S*?)([<\[])(hex|alnum|upper|digit|base64|lower),(\d+)[>\]]")


def written(lines: list[tuple[str, str]], seed: int) -> list[tuple[str, str, list[str]]]:
    """(text, path, secrets) of each line, with its random parts drawn."""
    r, out = random.Random(seed), []
    for line, path in lines:
        marks: list[str] = []

        def drawn(m: re.Match, marks: list[str] = marks) -> str:
            part = "".join(r.choice(KINDS[m[3]]) for _ in range(int(m[4])))
            if m[2] == "<":
                marks.append(part)
            return m[1] + part

        text = _MARK.sub(drawn, line)
        out.append((text, path, marks))
    return out
