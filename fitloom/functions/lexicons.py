"""Word lists, rules and limits. Every operator takes these as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# These lists decide the results, so they are stated as they must be.
LANGUAGES = (
    "python", "java", "javascript", "typescript", "c++", "c#", "c", "go", "golang",
    "rust", "ruby", "php", "swift", "kotlin", "scala", "r", "matlab", "perl",
    "haskell", "lua", "dart", "sql", "html", "css", "bash", "shell", "powershell",
    "objective-c", "assembly", "vhdl", "verilog", "julia", "elixir", "clojure",
)

TECHNOLOGIES = (
    "react", "angular", "vue", "next.js", "nextjs", "node.js", "nodejs", "express",
    "django", "flask", "fastapi", "spring", "spring boot", "rails", "laravel",
    "tensorflow", "pytorch", "keras", "scikit-learn", "sklearn", "pandas", "numpy",
    "opencv", "docker", "kubernetes", "k8s", "aws", "azure", "gcp", "google cloud",
    "firebase", "heroku", "vercel", "netlify", "jenkins", "github actions", "ci/cd",
    "terraform", "ansible", "linux", "unix", "git", "mongodb", "postgresql", "postgres",
    "mysql", "redis", "elasticsearch", "kafka", "rabbitmq", "graphql", "rest",
    "excel", "matplotlib", "seaborn", "ollama",
    "restful", "grpc", "apache", "nginx", "hadoop", "spark", "airflow", "dbt",
    "tableau", "power bi", "streamlit", "gradio", "langchain", "openai", "huggingface",
    "transformers", "bert", "gpt", "llm", "rag", "vector database", "pinecone",
    "chromadb", "supabase", "prisma", "tailwind", "bootstrap", "material ui",
    "figma", "jira", "confluence", "notion", "slack", "agile", "scrum",
    "s3", "lambda", "ec2", "dynamodb", "cloudfront", "sagemaker",
)

DOMAINS = {
    "machine learning": ("machine learning", "ml", "deep learning", "neural network"),
    "artificial intelligence": (
        "artificial intelligence", "ai", "nlp", "natural language processing", "computer vision",
    ),
    "data science": ("data science", "data analysis", "data analytics", "statistical"),
    "web development": (
        "web development", "frontend", "front-end", "backend", "back-end", "full-stack", "fullstack",
    ),
    "mobile development": ("mobile", "android", "ios", "react native", "flutter"),
    "cloud computing": ("cloud", "aws", "azure", "gcp", "devops", "infrastructure"),
    "cybersecurity": ("security", "cybersecurity", "penetration", "encryption"),
    "database": ("database", "sql", "nosql", "data engineering", "etl"),
    "systems": ("systems", "distributed", "operating system", "embedded"),
    "game development": ("game", "unity", "unreal", "graphics"),
}

SECTION_HEADERS = {
    "education": ("education", "education & certifications", "education and certifications"),
    "experience": (
        "experience", "work experience", "professional experience",
        "leadership & campus experience", "leadership & experience",
        "leadership experience", "campus experience",
    ),
    "projects": (
        "projects", "projects & hackathons", "projects and hackathons",
        "personal projects", "academic projects", "technical projects",
    ),
    "skills": (
        "skills", "technical skills", "core skills", "technologies",
        "tools & technologies", "core strengths",
    ),
    "certifications": ("certifications", "certificates", "licenses"),
    "summary": ("summary", "profile", "objective", "professional summary", "about"),
    "awards": ("awards", "honors", "achievements"),
    "activities": (
        "activities", "extracurricular", "volunteer", "involvement", "leadership", "organizations",
    ),
}

TITLE_WORDS = (
    "president", "vice", "manager", "director", "intern", "engineer", "developer",
    "analyst", "lead", "officer", "official", "coordinator", "assistant", "associate",
)

LEVEL_RULES = (
    ("student", ("student", "expected graduation", "bachelor", "pursuing",
                 "university", "college", "coursework", "gpa")),
    ("senior", ("senior engineer", "lead engineer", "principal", "staff engineer", "director")),
    ("mid-level", ("mid-level", "3+ years", "4+ years", "5+ years")),
)

CERTIFICATE_WORDS = (
    "google", "coursera", "aws", "microsoft", "meta", "ibm", "credential", "certificate",
)

KEYWORD_STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "are", "was", "were", "been",
    "have", "has", "had",
)

MATCH_STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "are", "was",
    "our", "you", "your", "will", "have", "has", "been", "can", "all",
    "about", "team", "work", "working", "experience", "role", "join",
    "looking", "company", "position", "opportunity", "including", "also",
    "new", "help", "use", "using", "build", "building", "strong", "able",
)

MATCH_TECH_TERMS = (
    "python", "java", "javascript", "typescript", "react", "node.js",
    "sql", "aws", "docker", "kubernetes", "tensorflow", "pytorch",
    "django", "flask", "fastapi", "spring", "angular", "vue",
    "machine", "learning", "data", "science", "ai", "ml",
    "c++", "go", "rust", "ruby", "swift", "kotlin",
)

TITLE_SIGNALS = (
    ("intern",),
    ("software", "engineer", "developer", "swe"),
    ("data", "ml", "ai", "machine learning", "backend",
     "frontend", "full stack", "fullstack", "cloud", "devops"),
)

TITLE_NOISE = ("intern", "internship", "-", "–", "@", "summer", "2026", "2025")

FALLBACK_ROLE = "Software Engineer Intern"

JOB_STATUSES = ("Not Applied", "Applied", "Interview", "Rejected", "Offer")
SHEET_STATUSES = ("Applied", "Not relevant")

BOARDS_A = (
    "airbnb", "figma", "notion", "stripe", "databricks", "anthropic",
    "openai", "vercel", "retool", "dbtlabs", "hashicorp", "datadog",
    "airtable", "plaid", "brex", "ramp", "rippling", "gusto",
)
BOARDS_B = (
    "netflix", "coinbase", "verkada", "anduril", "cloudflare",
    "scale", "snorkelai", "weights-and-biases", "figma",
)

MIN_SCORE = 5
SOURCE_CAP = 30
CURATED_CAP = 60
THREAD_CHILDREN = 200
DESCRIPTION_LENGTH = 500
PLACES = 3
SEARCH_ROLES = 4
ROLE_CAP = 8
# End of fixed values.


@dataclass(frozen=True)
class RoleRule:
    role: str
    min_matches: int
    triggers: tuple[str, ...]


# Role rules in rule order.
ROLE_RULES = (
    RoleRule("Machine Learning Engineer Intern", 2, (
        "python", "machine learning", "tensorflow", "pytorch", "deep learning", "ml",
        "scikit-learn", "keras")),
    RoleRule("AI Engineer Intern", 2, (
        "python", "ai", "artificial intelligence", "nlp", "natural language processing", "llm",
        "langchain", "openai", "rag", "transformers")),
    RoleRule("Data Science Intern", 2, (
        "data science", "pandas", "numpy", "statistics", "data analysis", "jupyter",
        "matplotlib", "r", "tableau", "power bi")),
    RoleRule("Data Analyst Intern", 2, (
        "data analysis", "sql", "excel", "tableau", "power bi", "analytics", "pandas",
        "data analytics")),
    RoleRule("Software Engineer Intern", 2, (
        "python", "java", "c++", "algorithms", "data structures", "software")),
    RoleRule("Backend Engineer Intern", 2, (
        "python", "django", "flask", "fastapi", "node.js", "express", "rest", "api", "backend",
        "postgresql", "mongodb")),
    RoleRule("Frontend Engineer Intern", 2, (
        "react", "vue", "angular", "javascript", "typescript", "html", "css", "frontend",
        "front-end", "tailwind")),
    RoleRule("Full Stack Engineer Intern", 2, (
        "react", "node.js", "javascript", "full-stack", "fullstack", "mongodb", "postgresql",
        "express")),
    RoleRule("DevOps Engineer Intern", 2, (
        "docker", "kubernetes", "aws", "azure", "gcp", "terraform", "ci/cd", "devops", "jenkins",
        "linux")),
    RoleRule("Cloud Engineer Intern", 2, (
        "aws", "azure", "gcp", "cloud", "lambda", "s3", "ec2", "infrastructure")),
    RoleRule("Data Engineer Intern", 2, (
        "sql", "etl", "airflow", "spark", "kafka", "data pipeline", "data engineering", "hadoop",
        "dbt")),
    RoleRule("Mobile Developer Intern", 2, (
        "android", "ios", "swift", "kotlin", "react native", "flutter", "mobile")),
    RoleRule("Cybersecurity Intern", 2, (
        "security", "cybersecurity", "penetration", "vulnerability", "encryption", "networking")),
    RoleRule("Computer Vision Engineer Intern", 2, (
        "computer vision", "opencv", "image", "video", "convolutional")),
    RoleRule("Product Management Intern", 3, (
        "product", "management", "roadmap", "stakeholder", "agile", "scrum", "jira")),
)
# End of fixed values.


def by_length(words) -> list[str]:
    """Longest first, ties alphabetical: the pinned order of lexicon hits."""
    return sorted(set(words), key=lambda w: (-len(w), w))


@dataclass(frozen=True)
class MatchTerms:
    """The word lists behind one match score."""

    stop_words: tuple[str, ...] = MATCH_STOP_WORDS
    tech_terms: tuple[str, ...] = MATCH_TECH_TERMS
    title_signals: tuple[tuple[str, ...], ...] = TITLE_SIGNALS
    title_noise: tuple[str, ...] = TITLE_NOISE


@dataclass(frozen=True)
class Limits:
    """What the readers leave out of landed payloads; by default nothing, and every board is read."""

    per_source: int | None = None  # postings of a role and source
    curated: int | None = None  # items of a curated list
    children: int | None = None  # comments of a thread that are looked at
    boards_a: tuple[str, ...] | None = None
    boards_b: tuple[str, ...] | None = None
    description: int | None = None  # characters of a description
    places: int | None = None  # places of a curated item


#: The limits of a run against live sites.
LIVE_LIMITS = Limits(SOURCE_CAP, CURATED_CAP, THREAD_CHILDREN, BOARDS_A, BOARDS_B, DESCRIPTION_LENGTH, PLACES)


@dataclass(frozen=True)
class ProfileTerms:
    """The word lists behind one parsed profile."""

    languages: tuple[str, ...] = LANGUAGES
    technologies: tuple[str, ...] = TECHNOLOGIES
    domains: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(DOMAINS))
    headers: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(SECTION_HEADERS))
    title_words: tuple[str, ...] = TITLE_WORDS
    levels: tuple = LEVEL_RULES
    certificate_words: tuple[str, ...] = CERTIFICATE_WORDS
    keyword_stop_words: tuple[str, ...] = KEYWORD_STOP_WORDS
    top_keywords: int = 30
    min_keyword_count: int = 2
