"""Declared input schemas: no inference pass, missing fields read as null."""

ENTRY = (
    "server struct<name: string, title: string, description: string, version: string, `$schema`: string, "
    "repository: struct<url: string, source: string>, websiteUrl: string, "
    "packages: array<struct<registryType: string, registryBaseUrl: string, identifier: string, version: string, "
    "transport: struct<type: string, url: string>, runtimeHint: string, runtimeArguments: array<string>, "
    "packageArguments: array<string>, environmentVariables: array<struct<name: string, description: string, "
    "isRequired: boolean, isSecret: boolean, `default`: string, format: string, choices: array<string>>>>>, "
    "remotes: array<struct<type: string, url: string>>>, "
    "_meta map<string, struct<status: string, publishedAt: string, updatedAt: string, "
    "statusChangedAt: string, isLatest: boolean>>"
)

NPM = (
    "`dist-tags` struct<latest: string>, name string, license string, "
    "versions map<string, struct<license: string, deprecated: string, repository: string, "
    "dependencies: map<string, string>, devDependencies: map<string, string>, scripts: map<string, string>, "
    "dist: struct<tarball: string>>>, "
    "time map<string, string>, maintainers string, __http_error__ int"
)

PYPI = (
    "info struct<name: string, version: string, summary: string, license: string, requires_python: string, "
    "author: string, project_urls: map<string, string>, requires_dist: array<string>>, "
    "releases map<string, array<struct<yanked: boolean>>>, "
    "urls array<struct<packagetype: string, url: string>>, __http_error__ int"
)

REPO = (
    "full_name string, owner struct<login: string>, name string, html_url string, description string, "
    "stargazers_count bigint, forks_count bigint, subscribers_count bigint, open_issues_count bigint, "
    "language string, topics array<string>, license struct<spdx_id: string>, created_at string, "
    "pushed_at string, updated_at string, size bigint, fork boolean, archived boolean, has_issues boolean, "
    "default_branch string, __http_error__ int"
)

RELEASES = (
    "array<struct<tag_name: string, name: string, published_at: string, prerelease: boolean, "
    "draft: boolean, assets: array<string>>>"
)

MANIFEST = "path string, bytes bigint, sha256 string"
