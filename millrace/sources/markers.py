"""What tells that a repository uses a kind of tool: packages, file names, folders, extensions and keys of its manifests.

An own selection from the tools' documentation. A row is (flag, kind of evidence, names, least number of paths); evidence
meets a repository's paths and packages in an equality join, so a longer list costs no more passes.
"""

from __future__ import annotations

_MARKERS = [
    ("static_types", "extension", "ts tsx mts cts", 1),
    ("static_types", "file", "tsconfig.json mypy.ini pyrightconfig.json", 1),
    ("static_types", "package", "typescript mypy pyright sorbet", 1),
    ("unit_tests", "folder", "test tests __tests__ spec", 1),
    ("unit_tests", "file", "conftest.py pytest.ini tox.ini", 1),
    ("unit_tests", "package", "jest vitest mocha ava pytest nose2 rspec minitest junit org.junit.jupiter:junit-jupiter", 1),
    ("browser_tests", "package", "cypress @playwright/test puppeteer webdriverio selenium capybara", 1),
    ("container", "file", "Dockerfile Containerfile compose.yaml compose.yml docker-compose.yml .dockerignore", 1),
    ("cluster", "folder", "k8s helm charts kustomize argocd", 1),
    ("cluster", "file", "Chart.yaml skaffold.yaml kustomization.yaml", 1),
    ("pipeline", "folder", "workflows .circleci .buildkite .tekton", 1),
    ("pipeline", "file", ".gitlab-ci.yml .drone.yml Jenkinsfile azure-pipelines.yml appveyor.yml", 1),
    ("linting", "file", "eslint.config.js .eslintrc.json .golangci.yml .rubocop.yml ruff.toml .flake8 clippy.toml", 1),
    ("linting", "package", "eslint ruff flake8 pylint rubocop", 1),
    ("formatting", "file", ".prettierrc .editorconfig .clang-format rustfmt.toml", 1),
    ("formatting", "package", "prettier black gofumpt", 1),
    ("relational", "package", "@prisma/client drizzle-orm knex sqlalchemy django activerecord gorm.io/gorm diesel org.hibernate:hibernate-core", 1),
    ("documents", "package", "mongoose mongodb pymongo mongoid", 1),
    ("service", "package", "express fastify @nestjs/core flask fastapi django sinatra github.com/gin-gonic/gin axum actix-web", 1),
    ("full_stack", "package", "next nuxt astro @sveltejs/kit rails", 1),
    ("interface", "package", "react vue svelte solid-js @angular/core", 1),
    ("remote_calls", "package", "@grpc/grpc-js @trpc/server grpcio tonic google.golang.org/grpc", 1),
    ("graph_api", "extension", "graphql gql", 1),
    ("graph_api", "package", "graphql graphql-yoga strawberry-graphql async-graphql", 1),
    ("sign_in", "package", "passport next-auth oidc-provider authlib devise omniauth", 1),
    ("payments", "package", "stripe braintree adyen-api-library", 1),
    ("cache", "package", "redis ioredis memcached pymemcache dalli", 1),
    ("jobs", "package", "bullmq agenda celery dramatiq sidekiq", 1),
    ("mail", "package", "nodemailer postmark mailgun.js lettre", 1),
    ("telemetry", "package", "@opentelemetry/api @sentry/node prom-client sentry-sdk structlog go.uber.org/zap tracing", 1),
    ("schema_changes", "folder", "migrations migrate alembic flyway", 1),
    ("sample_settings", "file", ".env.example .env.sample .env.template", 1),
    ("throttling", "package", "express-rate-limit @fastify/rate-limit slowapi rack-attack", 1),
    ("safe_headers", "package", "helmet secure-headers flask-talisman", 1),
    ("forgery_guard", "package", "csrf-csrf csrf-sync flask-wtf", 1),
    ("workspaces", "file", "pnpm-workspace.yaml lerna.json nx.json turbo.json go.work", 1),
    ("workspaces", "key", "workspaces", 1),
    ("hosted", "file", "vercel.json netlify.toml fly.toml serverless.yml render.yaml", 1),
    ("features", "folder", "features modules", 4),
    ("routes", "folder", "api routes", 3),
    ("source_folder", "folder", "src", 1),
    ("page_folder", "folder", "app pages", 1),
]
MARKERS = [(flag, kind, name, least) for flag, kind, names, least in _MARKERS for name in names.split()]
FLAGS = list(dict.fromkeys(m[0] for m in _MARKERS))
