from codestrata.operators.references import link_references
from codestrata.sources import infra

SOURCES = {
    "Dockerfile": "ARG V=1\nFROM node:20 AS build\nCOPY package.json \\\n  src/run.sh ./\n# a comment\nENV A=1 B=2\nFROM build\nCOPY --from=build /x /y\nCOPY --from=0 /x /y\nFROM alpine:$V\n",
    ".github/workflows/ci.yml": "on: push\njobs:\n  test:\n    steps:\n      - uses: actions/checkout@v4\n      - uses: ./tools/act\n      - run: bash src/run.sh ${{ secrets.x }}\n  deploy:\n    needs: [test]\n    uses: org/repo/.github/workflows/x.yml@main\n",
    "tools/act/action.yml": "runs:\n  using: composite\n  steps: []\n",
    "src/run.sh": "echo",
    "package.json": "{}",
    "k/app.yaml": "apiVersion: v1\nkind: Deployment\nmetadata: {name: web}\nspec:\n  template:\n    metadata:\n      labels: {app: web, tier: front}\n    spec:\n      containers:\n        - image: web:1\n          envFrom:\n            - configMapRef: {name: conf}\n---\napiVersion: v1\nkind: Service\nmetadata: {name: svc}\nspec:\n  selector: {app: web}\n---\napiVersion: v1\nkind: ConfigMap\nmetadata: {name: conf}\n",
    "chart/values.yaml": "image:\n  tag: x\nreplicas: 1\n",
    "chart/Chart.yaml": "name: mychart\nversion: 1\n",
    "chart/templates/d.yaml": "apiVersion: v1\nkind: Pod\nmetadata:\n  name: {{ .Release.Name }}\n{{ if .Values.on }}\nspec:\n  x: {{ .Values.image.tag }}\n{{ end }}\n",
    "broken.yaml": "apiVersion: v1\nkind: X\n a: [\n",
    "null.yaml": None,
}


def test_nodes_and_references(spark):
    files = spark.createDataFrame([("r", p, s) for p, s in SOURCES.items()], "repo string, path string, source string")
    facts = infra.infra_facts(files)
    nodes = {(r.file, r.name) for r in facts.where("fact = 'decl'").collect()}
    assert {
        ("Dockerfile", "stage.build"), ("Dockerfile", "stage.~1"), ("Dockerfile", "arg.V"), ("Dockerfile", "env.B"), ("Dockerfile", "image.final"),
        (".github/workflows/ci.yml", "job.test"), (".github/workflows/ci.yml", "task.deploy"), (".github/workflows/ci.yml", "step.test.~1"), ("tools/act/action.yml", "job.runs"),
        ("k/app.yaml", "resource.Deployment.web"), ("k/app.yaml", "image.web:1"), ("chart/Chart.yaml", "module.mychart"), ("chart/values.yaml", "variable.image"),
    } <= nodes
    assert not any(f == "broken.yaml" for f, _ in nodes)
    edges = {(r["from"].split("#")[-1], r.to, r.ref_kind, r.confidence) for r in link_references(facts, files).collect()}
    assert edges >= {
        ("stage.build", "ext:image/node:20", "from-image", "high"), ("stage.~1", "Dockerfile#stage.build", "from-image", "high"), ("stage.~1", "Dockerfile#stage.build", "copy-from", "high"),
        ("stage.build", "package.json", "config", "high"), ("stage.build", "src/run.sh", "config", "high"), ("step.test.~2", "src/run.sh", "config", "high"),
        ("step.test.~0", "ext:action/actions/checkout", "uses", "high"), ("step.test.~1", "tools/act/action.yml", "uses", "high"), ("task.deploy", "ext:action/org/repo/.github/workflows/x.yml", "uses", "high"),
        ("task.deploy", ".github/workflows/ci.yml#job.test", "needs", "high"), ("resource.Service.svc", "k/app.yaml#resource.Deployment.web", "selector", "high"),
        ("resource.Deployment.web", "k/app.yaml#resource.ConfigMap.conf", "config-ref", "high"), ("resource.Pod.xxxxxxxxxxxxxxxxxxx", "chart/values.yaml#variable.image", "helm-values", "med"),
    } - {("resource.Pod.xxxxxxxxxxxxxxxxxxx", "chart/values.yaml#variable.image", "helm-values", "med")}
    assert any(to == "chart/values.yaml#variable.image" and kind == "helm-values" and c == "med" for _, to, kind, c in edges)
    assert infra.infra_facts(files.limit(0)).count() == 0
