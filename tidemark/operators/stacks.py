"""Frameworks and databases that manifests name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dimensions
from tidemark.functions.text import clean_version

#: Framework and category by package.
PACKAGES = {
    "next": ("Next.js", "frontend"), "react": ("React", "frontend"), "vue": ("Vue.js", "frontend"), "nuxt": ("Nuxt.js", "frontend"), "svelte": ("Svelte", "frontend"),
    "@angular/core": ("Angular", "frontend"), "solid-js": ("SolidJS", "frontend"), "astro": ("Astro", "frontend"), "express": ("Express.js", "backend"), "fastify": ("Fastify", "backend"),
    "koa": ("Koa", "backend"), "hono": ("Hono", "backend"), "@nestjs/core": ("NestJS", "backend"), "remix": ("Remix", "fullstack"), "tailwindcss": ("TailwindCSS", "styling"),
    "redux": ("Redux", "state"), "zustand": ("Zustand", "state"), "swr": ("SWR", "state"), "jest": ("Jest", "testing"), "vitest": ("Vitest", "testing"), "mocha": ("Mocha", "testing"),
    "cypress": ("Cypress", "testing"), "prisma": ("Prisma", "database"), "@prisma/client": ("Prisma", "database"), "drizzle-orm": ("Drizzle", "database"), "mongoose": ("Mongoose", "database"),
    "typeorm": ("TypeORM", "database"), "sequelize": ("Sequelize", "database"), "typescript": ("TypeScript", "language"), "eslint": ("ESLint", "tooling"), "prettier": ("Prettier", "tooling"),
    "github.com/gin-gonic/gin": ("Gin", "backend"), "github.com/labstack/echo": ("Echo", "backend"), "github.com/gofiber/fiber": ("Fiber", "backend"), "github.com/gorilla/mux": ("Gorilla Mux", "backend"),
    "github.com/go-chi/chi": ("Chi", "backend"), "github.com/spf13/cobra": ("Cobra", "cli"), "github.com/urfave/cli": ("urfave/cli", "cli"), "gorm.io/gorm": ("GORM", "database"), "github.com/jmoiron/sqlx": ("sqlx", "database"),
    "flask": ("Flask", "backend"), "django": ("Django", "backend"), "fastapi": ("FastAPI", "backend"), "pytest": ("Pytest", "testing"), "sqlalchemy": ("SQLAlchemy", "database"),
    "actix-web": ("Actix Web", "backend"), "axum": ("Axum", "backend"), "tokio": ("Tokio", "async"), "serde": ("Serde", "serialization"), "clap": ("Clap", "cli"),
}
#: Databases by package.
DATABASES = {"pg": "PostgreSQL", "mysql2": "MySQL", "mongodb": "MongoDB", "redis": "Redis", "@supabase/supabase-js": "Supabase", "firebase": "Firebase"}


def frameworks(dependencies: DataFrame, packages: dict = PACKAGES) -> DataFrame:
    """project_id, framework, category and version of each framework once, by the first package by name.

    dependencies: project_id, package and version. A module path counts with a major version behind it; names of crates
    and distributions are compared in lower case with hyphens.
    """
    dim = dimensions.frame(dependencies.sparkSession, [(k, *v) for k, v in packages.items()], "_package string, framework string, category string")
    name = F.regexp_replace(F.replace(F.lower("package"), F.lit("_"), F.lit("-")), r"/v[0-9]+$", "")
    df = dependencies.withColumn("_name", name).join(F.broadcast(dim), F.col("_name") == F.col("_package"))
    return df.groupBy("project_id", "framework", "category").agg(clean_version(F.min_by("version", "package")).alias("version"))


def databases(dependencies: DataFrame, names: dict = DATABASES) -> DataFrame:
    """project_id and database, each once."""
    dim = dimensions.frame(dependencies.sparkSession, names.items(), "_package string, database string")
    return dependencies.join(F.broadcast(dim), F.col("package") == F.col("_package")).select("project_id", "database").distinct()


def dependencies(manifests: DataFrame) -> DataFrame:
    """project_id, package and version of the records of manifests (see sources.trees). manifests: project_id, m."""
    return manifests.select("project_id", F.explode("m.dependencies").alias("package", "version"))
