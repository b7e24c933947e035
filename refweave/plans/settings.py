"""What a run needs from its surroundings, checked where it is asked for and nowhere at import."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from refweave.sources.readers import exists, make_folder

#: Names of the settings, and the folders below the root.
REQUIRED = {"MY_EMAIL": "email", "DEFAULT_UI_USERNAME": "username", "TEAM_NAME": "team", "GOOGLE_DRIVE_FOLDER_ID": "drive_folder", "OPENCITATIONS_ACCESS_TOKEN": "opencitations_token"}
FOLDERS = {"raw": "data/raw", "processed": "data/processed", "figures": "reports/figures"}


class SettingsError(ValueError):
    pass


def read_env_file(path: str) -> dict[str, str]:
    """NAME=value lines; blank lines and those behind # don't count, quotes around a value go."""
    out = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            name, equals, value = line.strip().removeprefix("export ").partition("=")
            if equals and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("\"'")
    return out


@dataclass(frozen=True)
class Settings:
    email: str
    username: str
    team: str
    drive_folder: str
    opencitations_token: str
    root: str

    @classmethod
    def of(cls, root: str, env: Mapping[str, str] | None = None) -> Settings:
        """From an environment (the process's own by default); all missing names are told at once."""
        env = os.environ if env is None else env
        if missing := [name for name in REQUIRED if not env.get(name)]:
            raise SettingsError(f"not set: {', '.join(missing)}")
        return cls(root=root.rstrip("/"), **{field: env[name] for name, field in REQUIRED.items()})

    def path(self, folder: str, *names: str) -> str:
        return "/".join([self.root, FOLDERS[folder], *names])

    def make_folders(self, spark: SparkSession) -> None:
        for folder in FOLDERS:
            make_folder(spark, self.path(folder))

    def references_mode(self, spark: SparkSession, source: str = "opencitations") -> dict:
        """The config of the reference steps: whether answers are there already, and who is asked."""
        return {"references_on_disk": exists(spark, self.path("processed", f"references_{source}.parquet")), "references_source": source}

    def articles_mode(self, spark: SparkSession) -> dict:
        """The config of the article steps: from the stored table if it is there, else from the search."""
        return {"loading_from": "local" if exists(spark, self.path("processed", "medline_database.parquet")) else "online"}
