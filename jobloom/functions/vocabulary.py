"""Skill names."""

from __future__ import annotations

# Skills and their other names.
SKILLS: dict[str, tuple[str, ...]] = {
    "go": ("golang",), "python": ("py", "python3"), "java": (), "javascript": ("js", "ecmascript"), "typescript": ("ts",), "rust": (),
    "c++": ("cpp",), "c#": ("csharp", ".net"), "ruby": (), "php": (), "kotlin": (), "swift": (), "scala": (),
    "postgresql": ("postgres", "psql", "pgsql"), "mysql": ("mariadb",), "mongodb": ("mongo",), "redis": (),
    "elasticsearch": ("elastic search", "opensearch"), "cassandra": (), "dynamodb": (), "clickhouse": (), "django": (), "flask": ("fastapi",),
    "rails": ("ruby on rails",), "spring": ("spring boot",), "react": ("reactjs", "react.js"), "vue": ("vuejs", "vue.js"), "svelte": ("sveltekit",),
    "angular": (), "node.js": ("nodejs", "node"), "kubernetes": ("k8s",), "docker": ("containers",), "terraform": (), "aws": ("amazon web services",),
    "gcp": ("google cloud",), "azure": (), "kafka": ("apache kafka",), "rabbitmq": (), "grpc": (), "graphql": (),
    "ci/cd": ("cicd", "continuous integration", "github actions", "gitlab ci", "jenkins", "circleci"),
    "observability": ("opentelemetry", "otel", "prometheus", "grafana", "datadog", "splunk", "sentry"), "microservices": (),
    "rest": ("restful", "rest api"), "sql": (), "linux": ("unix",), "git": (), "c": (), "r": (), "perl": (), "elixir": ("phoenix",), "erlang": (),
    "haskell": (), "clojure": (), "dart": ("flutter",), "objective-c": ("objc",), "bash": ("shell scripting", "shell script"), "powershell": (),
    "spark": ("apache spark", "pyspark"), "airflow": ("apache airflow",), "dbt": (), "snowflake": (), "databricks": (), "bigquery": (),
    "redshift": (), "hadoop": (), "flink": ("apache flink",), "pandas": (), "numpy": (), "etl": ("data pipelines", "data pipeline"), "pytorch": (),
    "tensorflow": (), "scikit-learn": ("sklearn",), "llm": ("large language model", "large language models", "genai", "generative ai"),
    "nlp": ("natural language processing",), "mlops": (), "ansible": (), "pulumi": (), "helm": (), "nginx": (), "envoy": (),
    "istio": ("service mesh",), "kafka streams": (), "serverless": ("aws lambda", "cloud functions"), "cdn": ("cloudflare", "cloudfront"),
    "sqlite": (), "neo4j": ("graph database",), "memcached": (), "kinesis": (), "sqs": (), "s3": ("object storage",), "next.js": ("nextjs",),
    "tailwind": ("tailwindcss",), "webpack": (), "vite": (), "css": (), "html": (), "accessibility": ("wcag", "a11y"),
    "testing": ("unit testing", "integration testing", "test automation"), "tdd": ("test driven development",), "code review": (),
    "agile": ("scrum", "kanban"), "distributed systems": (), "system design": (), "api design": (), "security": ("appsec", "application security"),
    "performance": ("performance tuning", "profiling"), "caching": (), "monitoring": ("alerting", "on-call", "oncall"), "scalability": (),
    "websockets": ("websocket",), "oauth": ("oidc", "sso"), "protobuf": ("protocol buffers",),
}

# Written forms that are not the name with raised first letters.
DISPLAY = {
    "aws": "AWS", "gcp": "GCP", "sql": "SQL", "nosql": "NoSQL", "html": "HTML", "css": "CSS", "http": "HTTP", "json": "JSON", "yaml": "YAML",
    "xml": "XML", "jwt": "JWT", "oauth": "OAuth", "rest": "REST", "grpc": "gRPC", "graphql": "GraphQL", "api": "API", "llm": "LLM", "nlp": "NLP",
    "ml": "ML", "ai": "AI", "mlops": "MLOps", "ci/cd": "CI/CD", "tdd": "TDD", "etl": "ETL", "orm": "ORM", "crm": "CRM", "saas": "SaaS", "ui": "UI",
    "ux": "UX", "ios": "iOS", "macos": "macOS", "postgresql": "PostgreSQL", "mysql": "MySQL", "mongodb": "MongoDB", "javascript": "JavaScript",
    "typescript": "TypeScript", "node.js": "Node.js", "nodejs": "Node.js", "c++": "C++", "c#": "C#", ".net": ".NET", "php": "PHP",
    "k8s": "Kubernetes", "github actions": "GitHub Actions", "gitlab ci": "GitLab CI", "dynamodb": "DynamoDB", "redis": "Redis",
    "elasticsearch": "Elasticsearch", "rabbitmq": "RabbitMQ", "kafka": "Kafka", "grafana": "Grafana", "prometheus": "Prometheus",
    "opentelemetry": "OpenTelemetry", "webrtc": "WebRTC", "websockets": "WebSockets", "wasm": "WebAssembly", "cdn": "CDN", "dns": "DNS", "tls": "TLS",
    "ssl": "SSL", "vpc": "VPC", "iam": "IAM", "s3": "S3", "ec2": "EC2", "rds": "RDS", "sre": "SRE", "qa": "QA", "abac": "ABAC", "rbac": "RBAC",
    "spa": "SPA", "ssr": "SSR", "seo": "SEO", "dsl": "DSL", "cqrs": "CQRS", "ddd": "DDD", "ipc": "IPC", "rpc": "RPC", "vue.js": "Vue.js",
    "next.js": "Next.js", "nuxt.js": "Nuxt.js",
}

# How skills are written where raising the first letter of each word is not enough.
DISPLAY = {
    "aws": "AWS", "gcp": "GCP", "sql": "SQL", "nosql": "NoSQL", "html": "HTML", "css": "CSS", "http": "HTTP", "json": "JSON", "yaml": "YAML", "xml": "XML", "jwt": "JWT", "oauth": "OAuth", "rest": "REST", "grpc": "gRPC",
    "graphql": "GraphQL", "api": "API", "llm": "LLM", "nlp": "NLP", "ml": "ML", "ai": "AI", "mlops": "MLOps", "ci/cd": "CI/CD", "tdd": "TDD", "etl": "ETL", "orm": "ORM", "crm": "CRM", "saas": "SaaS", "ui": "UI", "ux": "UX",
    "ios": "iOS", "macos": "macOS", "postgresql": "PostgreSQL", "mysql": "MySQL", "mongodb": "MongoDB", "javascript": "JavaScript", "typescript": "TypeScript", "node.js": "Node.js", "nodejs": "Node.js", "c++": "C++", "c#": "C#",
    ".net": ".NET", "php": "PHP", "k8s": "Kubernetes", "github actions": "GitHub Actions", "gitlab ci": "GitLab CI", "dynamodb": "DynamoDB", "redis": "Redis", "elasticsearch": "Elasticsearch", "rabbitmq": "RabbitMQ",
    "kafka": "Kafka", "grafana": "Grafana", "prometheus": "Prometheus", "opentelemetry": "OpenTelemetry", "webrtc": "WebRTC", "websockets": "WebSockets", "wasm": "WebAssembly", "cdn": "CDN", "dns": "DNS", "tls": "TLS",
    "ssl": "SSL", "vpc": "VPC", "iam": "IAM", "s3": "S3", "ec2": "EC2", "rds": "RDS", "sre": "SRE", "qa": "QA", "abac": "ABAC", "rbac": "RBAC", "spa": "SPA", "ssr": "SSR", "seo": "SEO", "dsl": "DSL", "cqrs": "CQRS",
    "ddd": "DDD", "ipc": "IPC", "rpc": "RPC", "vue.js": "Vue.js", "next.js": "Next.js", "nuxt.js": "Nuxt.js",
}
